"""Run queries() against oracle_sql() with DuckDB: row count, column names, values.

    python -m tests.oracle_check [--sf /root/testdata/sf0.01] [names...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}") if v != v.to_integral_value() else int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date,)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_norm(c[i]) for c in cols) for i in range(table.num_rows)]
    rows.sort(key=repr)
    return names, rows


def compare(spark_table, duck_table):
    sn, sr = _rows(spark_table)
    dn, dr = _rows(duck_table)
    problems = []
    if sn != dn:
        problems.append(f"columns differ: spark={sn} duck={dn}")
    if len(sr) != len(dr):
        problems.append(f"rows differ: spark={len(sr)} duck={len(dr)}")
    if not problems and sr != dr:
        bad = next(i for i, (a, b) in enumerate(zip(sr, dr)) if a != b)
        problems.append(f"values differ at sorted row {bad}: spark={sr[bad]} duck={dr[bad]}")
    return problems


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--conf", action="append", default=[], help="extra session conf k=v")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "America/New_York"))
    for kv in a.conf:
        k, v = kv.split("=", 1)
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    qs, os_ = E.queries(), E.oracle_sql()
    names = a.names or list(qs)
    failed = 0
    for n in names:
        t = time.time()
        try:
            st = qs[n](spark, a.sf).toArrow()
            if n not in os_:
                print(f"{n:24s} rows-only {st.num_rows} ({time.time() - t:.1f}s)")
                continue
            dtab = con.sql(os_[n]).arrow()
            if hasattr(dtab, "read_all"):
                dtab = dtab.read_all()
            probs = compare(st, dtab)
        except Exception as e:  # noqa: BLE001
            probs = [f"error: {type(e).__name__}: {str(e)[:600]}"]
        status = "OK" if not probs else "FAIL"
        failed += bool(probs)
        print(f"{n:24s} {status} ({time.time() - t:.1f}s) {'; '.join(probs)}", flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

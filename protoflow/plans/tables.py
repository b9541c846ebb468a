"""Table landing and small reports: write_table, read_table, table_detail, shape, ingest_report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import create_once, read_small, small_files
from ..functions.lattice import conform, join_schemas

SCHEMA_LOG = "_schema"          # folder beside the data of a path table; file scans skip its name
TRIES = 20
DYNAMIC = "'partitionOverwriteMode'='dynamic'"


def write_table(df: DataFrame, path: str | None = None, name: str | None = None,
                mode: str = "overwrite", partition_by="view_date", fmt: str = "parquet", rebalance: bool = True) -> None:
    """Idempotent landing: with ``mode="overwrite"`` only the partitions present in
    ``df`` are replaced (dynamic partition overwrite), so rerunning a day replaces
    that day and leaves the others.  ``name`` registers a catalog table (at ``path``
    when given, so the data sits in the shared folder, not a local warehouse).

    The table's schema grows: it becomes the join of its own and ``df``'s (new columns and nested
    fields are added, numbers widen, what ``df`` lacks is NULL in its rows); files written before are
    read with the wider schema and not rewritten.  Types without a join are a ``SchemaConflict`` and
    nothing is written.  ``rebalance`` shuffles the rows by partition, so that a partition gets a few
    files of the session's advisory size whatever the number of tasks.
    """
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if name is None and path is None:
        raise ValueError("give path and/or name")
    spark = df.sparkSession
    grows = mode == "append" or (mode == "overwrite" and bool(parts))     # else the whole table is new
    known = name is not None and grows and spark.catalog.tableExists(name)
    if known:
        df = conform(df, _evolve_catalog(spark, name, df.schema))
    elif grows and name is None:
        df = conform(df, _evolve_path(spark, path, df.schema, fmt))
    if rebalance and parts:
        df = df.hint("rebalance", *parts)
    w = df.write.format(fmt).mode(mode).option("partitionOverwriteMode", "dynamic")
    if parts:
        w = w.partitionBy(*parts)
    if name is None:
        w.save(path)
    elif known:
        # insertInto binds by position and takes the overwrite mode from the table, not from the writer
        if "partitionOverwriteMode=dynamic" not in _described(spark, name).get("Storage Properties", ""):
            spark.sql(f"ALTER TABLE {name} SET SERDEPROPERTIES ({DYNAMIC})")
        df.select(*spark.table(name).columns).write.mode(mode).insertInto(name)
    else:
        (w.option("path", path) if path is not None else w).saveAsTable(name)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table at ``path`` with the schema of its log, whichever files hold which columns."""
    schema = _logged(spark, path)[1]
    reader = spark.read.format(fmt)
    return (reader if schema is None else reader.schema(schema)).load(path)


def _logged(spark: SparkSession, path: str) -> tuple[int, T.StructType | None]:
    """(number, schema) of the newest entry of the table's schema log; (0, None) without a log."""
    entries = small_files(spark, f"{path.rstrip('/')}/{SCHEMA_LOG}")
    if not entries:
        return 0, None
    newest = entries[-1]
    return int(newest.rsplit("/", 1)[1].split(".")[0]), T.StructType.fromJson(json.loads(read_small(spark, newest)))


def _evolve_path(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> T.StructType:
    """The schema to write with: the join of the log's newest and ``schema``, entered in the log first.

    An entry is a numbered file created only if absent, so two writers cannot both extend one
    version: the later joins with what the earlier entered.
    """
    for _ in range(TRIES):
        number, have = _logged(spark, path)
        if have is None and _has_data(spark, path):
            have = spark.read.format(fmt).load(path).schema       # a table from before the log
        want = _nullable(schema if have is None else join_schemas(have, schema))
        if number and want == have:
            return want
        entry = f"{path.rstrip('/')}/{SCHEMA_LOG}/{number + 1:010d}.json"
        if create_once(spark, entry, json.dumps(want.jsonValue()).encode()):
            return want
    raise RuntimeError(f"{TRIES} writers in a row extended the schema of {path}; try again")


def _nullable(t):
    """``t`` with every column and field nullable, as files read them."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(_nullable(t.keyType), _nullable(t.valueType), True)
    return t


def _has_data(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(f.getPath().getName()[:1] not in "._" for f in fs.listStatus(folder))


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["col_name"].strip(): (r["data_type"] or "").strip()
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _evolve_catalog(spark: SparkSession, name: str, schema: T.StructType) -> T.StructType:
    """The schema of catalog table ``name`` after it was joined with ``schema``.

    New columns are added in place.  A change inside a column makes a table that lies at its own
    path be registered anew over the same files; one in the warehouse folder is refused, because
    dropping its entry would drop its files.
    """
    have = spark.table(name).schema
    want = _nullable(join_schemas(have, schema))
    if want == _nullable(have):
        return want
    known = {f.name.lower() for f in have.fields}
    new = [f for f in want.fields if f.name.lower() not in known]
    if _nullable(have).fields == [f for f in want.fields if f.name.lower() in known]:
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
        return want
    meta = _described(spark, name)
    if meta.get("Type") != "EXTERNAL":
        raise ValueError(f"a column of {name} changes inside and its files lie in the warehouse folder: "
                         "write the table with a path of its own")
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in want.fields)
    by = f" PARTITIONED BY ({', '.join(map(_quoted, parts))})" if parts else ""
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING {meta['Provider']} "
              f"OPTIONS ({DYNAMIC}){by} LOCATION '{meta['Location']}'")
    if parts:
        spark.catalog.recoverPartitions(name)
    return want


def table_detail(spark: SparkSession, name: str) -> DataFrame:
    """name, format, location, num_files, num_rows, partition_columns, size_bytes (one row).

    The stand-in for ``DESCRIBE DETAIL`` on plain Spark tables."""
    t = spark.table(name)
    meta = _described(spark, name)
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    # counted by one distributed job; the file list itself never goes to the driver
    files = t.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_metadata.file_size").alias("size"))
    stats = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return spark.createDataFrame(
        [(name, meta.get("Provider", ""), meta.get("Location", ""), int(stats["files"]), int(stats["n"]), ",".join(parts),
          int(stats["size"]))],
        "name string, format string, location string, num_files int, num_rows long, partition_columns string, "
        "size_bytes long")


def shape(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """n_rows, n_cols as a one-row DataFrame (the count runs as one aggregation job).

    ``rows`` is a DataFrame with as many rows that is cheaper to count, e.g. the messages that
    ``df`` decodes one by one: Spark cannot see that a decode keeps the number of rows."""
    return (df if rows is None else rows).agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def ingest_report(files: DataFrame, selected: DataFrame, key: str = "path",
                  by: str | None = None) -> DataFrame:
    """n_found, n_selected, pct_selected (per ``by`` when given) - the run's progress print.

    ``selected`` rows are marked on the listing by a left join on ``key``; one
    aggregation then counts both, so nothing is collected to the driver."""
    keys = [by] if by else []
    marked = files.join(selected.select(key, F.lit(True).alias("_sel")), key, "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_found"),
        F.count("_sel").alias("n_selected"),
    ).withColumn("pct_selected", F.round(F.col("n_selected") * 100.0 / F.col("n_found"), 2))


def flagged_report(files: DataFrame, flag: str = "selected", by: str | None = None) -> DataFrame:
    """``ingest_report`` of a listing whose selected rows are flagged (``flag_sample``): one aggregation, no join."""
    return files.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("n_found"), F.count_if(flag).alias("n_selected"),
    ).withColumn("pct_selected", F.round(F.col("n_selected") * 100.0 / F.col("n_found"), 2))

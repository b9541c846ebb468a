"""Incremental landing against a full landing, and counts taken by the write."""
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from protoflow.functions import descriptors as D
from protoflow.plans.catalog import view_tree
from protoflow.sources import landing as LD
from protoflow.sources.files import write_message_files
from protoflow.sources.landing import file_changes, ingest_files, land_changes, landed_table, write_counted
from protoflow.sources.listing import list_tree


@pytest.fixture
def place():
    base = tempfile.mkdtemp(prefix="pf-land-")
    for day in ("01", "02", "03"):
        for i in range(4):
            put(f"{base}/2024/01/{day}/00/f{i}.pb", f"{day}-{i}")
    put(f"{base}/other/undated.pb", "no date")
    return base, tempfile.mkdtemp(prefix="pf-table-") + "/t"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode())


def content(df):
    return sorted(((r["path"], r["modificationTime"], r["length"], bytes(r["content"]), r["view_date"]) for r in df.collect()),
                  key=repr)


def files_of(path, day):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/view_date={day}/*.parquet")}


def by_day(report):
    return {str(r["view_date"])[-2:]: (r["new"], r["changed"], r["gone"], r["same"]) for r in report.collect()}


def test_second_run_reads_and_writes_only_what_changed(spark, place, monkeypatch):
    base, path = place
    assert by_day(land_changes(spark, base, path)) == {"01": (4, 0, 0, 0), "02": (4, 0, 0, 0), "03": (4, 0, 0, 0), "ne": (1, 0, 0, 0)}
    untouched = files_of(path, "2024-01-03")
    put(f"{base}/2024/01/01/00/f1.pb", "another text")            # changed
    os.remove(f"{base}/2024/01/01/00/f2.pb")                      # gone
    put(f"{base}/2024/01/01/05/new.pb", "new")                    # new
    for i in range(4):
        os.remove(f"{base}/2024/01/02/00/f{i}.pb")                # a whole day
    put(f"{base}/2024/01/04/00/f0.pb", "04")                      # a new day
    opened = []
    inner = LD.read_listed
    monkeypatch.setattr(LD, "read_listed", lambda files, **kw: (opened.extend(r["path"] for r in files.collect()), inner(files, **kw))[1])
    report = land_changes(spark, base, path)
    assert by_day(report) == {"01": (1, 1, 1, 2), "02": (0, 0, 4, 0), "03": (0, 0, 0, 4), "04": (1, 0, 0, 0), "ne": (0, 0, 0, 1)}
    assert sorted(p.rsplit("/", 1)[1] for p in opened) == ["f0.pb", "f1.pb", "new.pb"]
    assert report.agg(F.sum("bytes_read")).first()[0] == len("another text") + len("new") + len("04")
    assert files_of(path, "2024-01-03") == untouched and untouched
    assert not os.path.exists(f"{path}/view_date=2024-01-02")
    full = tempfile.mkdtemp(prefix="pf-table-") + "/full"
    land_changes(spark, base, full)
    assert content(landed_table(spark, path)) == content(landed_table(spark, full))
    opened.clear()
    assert all(r["same"] and not (r["new"] or r["changed"] or r["gone"]) for r in land_changes(spark, base, path).collect())
    assert opened == []


def test_only_the_chosen_days_are_compared(spark, place):
    base, path = place
    land_changes(spark, base, path, days=["2024/01/01", "2024/01/0[2]"])
    assert landed_table(spark, path).count() == 8
    os.remove(f"{base}/2024/01/01/00/f0.pb")
    os.remove(f"{base}/2024/01/02/00/f0.pb")
    assert by_day(land_changes(spark, base, path, days="2024/01/02")) == {"02": (0, 0, 1, 3)}
    assert landed_table(spark, path).count() == 7                 # day 01 was not looked at


def test_two_trees_share_a_table(spark, place):
    base, path = place
    second = tempfile.mkdtemp(prefix="pf-land-")
    put(f"{second}/2024/01/01/00/f0.pb", "second")
    put(f"{second}/2024/01/09/00/f0.pb", "alone")
    land_changes(spark, base, path)
    land_changes(spark, second, path)
    assert landed_table(spark, path).count() == 15
    os.remove(f"{second}/2024/01/01/00/f0.pb")
    os.remove(f"{second}/2024/01/09/00/f0.pb")
    land_changes(spark, second, path)
    assert landed_table(spark, path).count() == 13
    for i in range(4):
        os.remove(f"{base}/2024/01/01/00/f{i}.pb")
    put(f"{second}/2024/01/01/00/f0.pb", "second")
    land_changes(spark, second, path)
    land_changes(spark, base, path)                               # the day keeps the other tree's file
    assert landed_table(spark, path).where("view_date = '2024-01-01'").count() == 1


def test_an_empty_tree_and_no_table(spark):
    base, path = tempfile.mkdtemp(prefix="pf-land-"), tempfile.mkdtemp(prefix="pf-table-") + "/none"
    assert land_changes(spark, base, path).count() == 0 and landed_table(spark, path).count() == 0
    assert file_changes(spark, base, path).count() == 0


def test_counts_come_from_the_write(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 == 0, "bad").alias("_error"), F.encode(F.lit("abc"), "UTF-8").alias("b"))
    scans = []
    path = tempfile.mkdtemp(prefix="pf-count-") + "/t"
    got = write_counted(df, lambda d: (scans.append(1), d.write.parquet(path)), bytes_col="b", error_col="_error")
    assert got == {"rows": 100, "bad": 10, "bytes": 300} and scans == [1]
    assert write_counted(df.limit(0), lambda d: d.write.parquet(path + "0"), bytes_col="id") == {"rows": 0, "bytes": 0}


def test_ingest_counts_files_that_are_gone_and_bad_messages(spark, sf_small):
    base = tempfile.mkdtemp(prefix="pf-ingest-")
    src = list_tree(spark, view_tree(spark, sf_small)).limit(5).collect()
    for i, r in enumerate(src):
        with open(r["path"][5:], "rb") as f:
            data = f.read()
        os.makedirs(f"{base}/2024/01/01/00", exist_ok=True)
        with open(f"{base}/2024/01/01/00/{i}.pb", "wb") as f:
            f.write(data if i else data[:-1])
    files = list_tree(spark, base)
    os.remove(f"{base}/2024/01/01/00/4.pb")                       # gone after the listing
    path = tempfile.mkdtemp(prefix="pf-ingest-") + "/t"
    got = ingest_files(spark, files, D.view_record(), path, fields=["view_id"]).first()
    size = sum(os.path.getsize(f"{base}/2024/01/01/00/{i}.pb") for i in range(4))
    assert tuple(got) == (5, 4, size, 3, 1) and spark.read.parquet(path).count() == 3


def test_counts_when_no_message_can_be_read(spark):
    base = tempfile.mkdtemp(prefix="pf-ingest-")
    for i in range(3):
        put(f"{base}/2024/01/01/00/{i}.pb", "\x7f\x7f")
    path = tempfile.mkdtemp(prefix="pf-ingest-") + "/t"
    got = ingest_files(spark, list_tree(spark, base), D.view_record(), path, fields=["view_id"]).first()
    assert tuple(got) == (3, 3, 6, 0, 3)
    none = ingest_files(spark, list_tree(spark, base).limit(0), D.view_record(), path + "0", fields=["view_id"]).first()
    assert tuple(none) == (0, 0, 0, 0, 0)


def test_written_files_are_landed_as_they_are(spark, place):
    _, path = place
    base = tempfile.mkdtemp(prefix="pf-land-")
    rows = spark.createDataFrame([("2024/01/01/00/a.pb", bytearray(b"x")), ("2024/01/01/01/b.pb", bytearray(b""))],
                                 "relpath string, value binary")
    write_message_files(rows, base)
    land_changes(spark, base, path)
    assert [r["length"] for r in landed_table(spark, path).orderBy("path").collect()] == [1, 0]

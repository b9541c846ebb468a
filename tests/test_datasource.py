"""The message file source and its writer."""
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from protoflow.plans.catalog import view_tree
from protoflow.sources.datasource import NAME, STAGING, FolderReader, register
from protoflow.sources.files import read_raw


@pytest.fixture
def source(spark):
    register(spark)
    register(spark)                                           # a second call does nothing
    return spark.read.format(NAME)


def key(df):
    return sorted((r["path"], r["modificationTime"], r["length"], bytes(r["content"]), r["view_date"], r["view_hour"])
                  for r in df.select("path", "modificationTime", "length", "content", "view_date", "view_hour").collect())


def test_equal_to_the_scan(spark, source, sf_small):
    base = view_tree(spark, sf_small)
    assert key(source.load(base)) == key(read_raw(spark, base))
    assert key(spark.read.format(NAME).option("splits", 3).load("file:" + base if base.startswith("/") else base)) \
        == key(read_raw(spark, base))
    some = spark.read.format(NAME).option("days", "2024/01/01").option("hours", "0, 13").load(base)
    assert key(some) == key(read_raw(spark, base, "2024/01/01", [0, 13]))
    day = spark.read.format(NAME).option("days", "2024/01/01").load(base)
    assert key(day) == key(read_raw(spark, base, "2024/01/01"))
    assert spark.read.format(NAME).option("days", "2031/01/01").load(base).count() == 0


def test_folders_outside_the_selection_are_not_planned(spark, sf_small):
    base = view_tree(spark, sf_small)
    reader = FolderReader({"path": base, "hours": "13"})
    assert {p.folder.rsplit("/", 1)[1] for p in reader.partitions()} == {"13"}


def test_filters_reach_the_source(spark, source, sf_small):
    base = view_tree(spark, sf_small)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format(NAME).option("push", "true").load(base)
        hit = df.where((F.col("view_date") == F.lit("2024-01-01").cast("date")) & F.col("view_hour").isin(0, 13) & (F.col("length") > 0))
        assert key(hit) == key(read_raw(spark, base, "2024/01/01", [0, 13]))
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert "view_hour" in plan and hit.count() > 0
        assert df.where("view_hour > 30").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_loose_files_and_odd_folders(spark, source):
    base = tempfile.mkdtemp(prefix="pf-src-")
    for rel in ("loose.pb", "2024/13/45/99/bad.pb", "2024/01/02/03/deep/er/x.pb", "2024/01/02/direct.pb", "2024/01/02/03/.hidden"):
        os.makedirs(os.path.dirname(f"{base}/{rel}"), exist_ok=True)
        with open(f"{base}/{rel}", "wb") as f:
            f.write(rel.encode())
    got = {os.path.basename(r["path"]): (str(r["view_date"]), r["view_hour"]) for r in source.load(base).collect()}
    assert got == {"loose.pb": ("None", None), "bad.pb": ("None", None), "x.pb": ("2024-01-02", 3), "direct.pb": ("None", None)}
    day = spark.read.format(NAME).option("days", "2024/01/02").load(base)
    assert sorted(os.path.basename(r["path"]) for r in day.collect()) == ["direct.pb", "x.pb"]
    assert spark.read.format(NAME).option("pathGlobFilter", "*.none").load(base).count() == 0


def rows(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(
        F.concat(F.lit("2024/01/01/"), F.lpad((F.col("id") % 3).cast("string"), 2, "0"), F.lit("/f"), F.col("id").cast("string")).alias("relpath"),
        F.encode(F.concat(F.lit("m"), F.col("id").cast("string")), "UTF-8").alias("content"))


def files(base):
    return {p[len(base) + 1:] for p in glob.glob(f"{base}/**", recursive=True) if os.path.isfile(p)}


def test_write_and_read_back(spark, source):
    base = tempfile.mkdtemp(prefix="pf-dst-")
    rows(spark, 50).write.format(NAME).mode("append").save(base)
    rows(spark, 20).write.format(NAME).mode("append").save(base)          # the same names again
    assert sorted(bytes(r["content"]).decode() for r in source.load(base).collect()) == sorted(f"m{i}" for i in range(50))
    assert len(files(base)) == 50 and not os.path.exists(f"{base}/{STAGING}")


def test_a_failed_task_leaves_no_file(spark, source):
    base = tempfile.mkdtemp(prefix="pf-dst-")
    bad = rows(spark, 40).withColumn("content", F.when(F.col("relpath").endswith("f39"), None).otherwise(F.col("content")))
    with pytest.raises(Exception, match="NULL"):
        bad.write.format(NAME).mode("append").save(base)
    assert files(base) == set() and not os.path.exists(f"{base}/{STAGING}")


def test_refusals(spark, source):
    base = tempfile.mkdtemp(prefix="pf-dst-")
    with pytest.raises(Exception, match="append"):
        rows(spark, 1).write.format(NAME).mode("overwrite").save(base)
    with pytest.raises(Exception, match="relpath"):
        spark.range(1).write.format(NAME).mode("append").save(base)

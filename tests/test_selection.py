"""Samples by selection against the window they replace."""
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from protoflow.operators import sampling as SP
from protoflow.operators.sampling import flag_sample, flag_tree, order_hash, sample_files, sample_tree
from protoflow.plans.tables import flagged_report, ingest_report
from tests.test_plans import plan


def by_window(df, prop, by, key, seed=0):
    w = Window.partitionBy(*by)
    return (df.withColumn("_r", F.row_number().over(w.orderBy(order_hash(F.col(key), seed), key)))
            .withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_r") <= F.floor(F.col("_n") * prop)).drop("_r", "_n"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def table(spark):
    return spark.range(5000).select(
        F.col("id").cast("string").alias("path"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None)
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 90).cast("string"))).alias("g"), (F.col("id") % 2).alias("h"), F.lit("x").alias("extra"))


@pytest.mark.parametrize("prop", [0.0, 0.003, 0.05, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("by", [["g"], ["g", "h"]])
def test_equals_the_window(spark, table, prop, by):
    got = flag_sample(table, prop, by, seed=3)
    assert got.count() == 5000 and got.columns == [*table.columns, "selected"]
    assert rows(got.where("selected").drop("selected")) == rows(by_window(table, prop, by, "path", seed=3))


@pytest.mark.parametrize("limit", [1, 5, 100])
def test_rounds_until_the_bucket_is_small(spark, table, monkeypatch, limit):
    monkeypatch.setattr(SP, "BOUNDARY_ROWS", limit)
    monkeypatch.setattr(SP, "PREFIX", 1)
    monkeypatch.setattr(SP, "CUT_ROWS", 0)                       # cuts joined, not broadcast
    got = flag_sample(table, 0.31, "g").where("selected").drop("selected")
    assert rows(got) == rows(sample_files(table, 0.31, "g"))


def test_rows_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(SP, "BOUNDARY_ROWS", 1)                  # equal keys can never be told apart by longer prefixes
    df = spark.range(100).select((F.col("id") % 4).cast("string").alias("path"), F.lit("a").alias("g"), F.col("id"))
    for prop in (0.1, 0.25, 0.33, 0.99):
        got = flag_sample(df, prop, "g").where("selected")
        assert got.count() == int(prop * 100)
        order = [r["path"] for r in df.orderBy(order_hash(F.col("path")), "path").collect()][:int(prop * 100)]
        assert sorted(r["path"] for r in got.collect()) == sorted(order)


def test_empty_and_keyless(spark, table):
    assert flag_sample(table.limit(0), 0.5, "g").count() == 0
    with pytest.raises(Exception, match="no path"):
        flag_sample(table.withColumn("path", F.lit(None).cast("string")), 0.5, "g").count()


def test_rows_are_neither_shuffled_nor_sorted(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    p = plan(flag_sample(ev, 0.05, "event_type", key="event_id"))
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, re.M)) == 2          # the rows and the cuts
    assert "hashpartitioning" not in p and "Sort" not in p and "Window" not in p


def test_tree_and_report(spark):
    base = "/data/tree"
    files = spark.range(400).select(F.concat(F.lit(base + "/"), F.when(F.col("id") % 9 == 0, "").otherwise(
        F.concat(F.lit("d"), (F.col("id") % 4).cast("string"), F.lit("/deep/"))), F.col("id").cast("string"), F.lit(".pb")).alias("path"))
    flagged = flag_tree(files, base, 0.3)
    assert rows(flagged.where("selected").select("path")) == rows(sample_tree(files, base, 0.3).select("path"))
    both = flagged.withColumn("d", F.substring("path", 1, 13))
    a = flagged_report(both, by="d")
    b = ingest_report(both.select("path", "d"), both.where("selected").select("path"), by="d")
    assert rows(a) == rows(b) and flagged_report(both).first()["n_found"] == 400

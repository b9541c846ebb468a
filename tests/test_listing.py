"""Listing by tasks, and read plans balanced by bytes."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from protoflow.functions import descriptors as D
from protoflow.plans.catalog import view_tree
from protoflow.sources import listing as L
from protoflow.sources.files import list_files, read_listed, read_messages
from tests.test_plans import plan


@pytest.fixture
def tree():
    base = tempfile.mkdtemp(prefix="pf-tree-")
    for day in ("2024/01/01", "2024/01/02", "2024/02/01"):
        for hour in ("00", "07", "23"):
            folder = f"{base}/{day}/{hour}"
            os.makedirs(f"{folder}/deep")
            for name, size in (("a.pb", 10), ("b.pb", 20), ("c.txt", 5), (".hidden", 1), ("_SUCCESS", 0)):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"x" * size)
            open(f"{folder}/deep/d.pb", "wb").close()
    with open(f"{base}/loose.pb", "wb") as f:
        f.write(b"loose")
    os.makedirs(f"{base}/empty")
    return base


def rows(df):
    return sorted((r["path"], r["modificationTime"], r["length"]) for r in df.collect())


@pytest.mark.parametrize("budget", [1, 4, 256])
def test_equal_to_the_file_scan(spark, tree, monkeypatch, budget):
    monkeypatch.setattr(L, "ROUND_FOLDERS", budget)              # many rounds, or one
    def whole(df):                                               # the scan leaves out files of no bytes
        assert df.where("length = 0").count() == 9 or "07" in df.first()["path"]
        return rows(df.where("length > 0"))

    assert whole(L.list_tree(spark, tree)) == rows(list_files(spark, tree))
    assert whole(L.list_tree(spark, "file:" + tree, glob="*.pb")) == rows(list_files(spark, tree, glob="*.pb"))
    assert whole(L.list_tree(spark, tree + "/", contains="/07/")) == rows(list_files(spark, tree, contains="/07/"))
    assert [r["path"] for r in L.list_tree(spark, tree, max_depth=0).collect()] == [f"file:{tree}/loose.pb"]


def test_folders_outside_the_selection_are_never_opened(spark, tree):
    found = L.walk_tree(spark, tree, days=["2024/01/01", "2024/02/01"], hours=[7])
    opened = {r["path"][len("file:" + tree):] for r in found.where("kind = 'folder'").collect()}
    assert opened == {"", "/2024", "/2024/01", "/2024/02", "/2024/01/01", "/2024/02/01", "/2024/01/01/07", "/2024/02/01/07",
                      "/2024/01/01/07/deep", "/2024/02/01/07/deep"}
    files = found.where("kind = 'file'")
    assert files.count() == 8 and files.where(F.col("path").contains("loose")).count() == 0
    whole = L.list_tree(spark, tree, days="2024/01/*")
    assert whole.count() == 2 * 3 * 4
    assert L.list_tree(spark, tree, days="2031/01/01").count() == 0


def test_only_new_files_by_time(spark, tree):
    os.utime(f"{tree}/loose.pb", (2_000_000_000, 2_000_000_000))
    assert [r["length"] for r in L.list_tree(spark, tree, modified_after="2033-01-01T00:00:00").collect()] == [5]


def test_missing_base_is_an_error(spark, tree):
    with pytest.raises(Exception, match="nowhere"):
        L.list_tree(spark, tree + "/nowhere")


def test_no_file_index_of_the_tree(spark, tree):
    p = plan(L.list_tree(spark, tree))
    # the scan is of the written listing, whatever the tree holds
    assert "Scan parquet" in p and "binaryFile" not in p and tree not in p


def parts_of(df):
    return [(r["p"], r["n"], r["b"], r["most"]) for r in
            df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
                F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.max("length").alias("most")).collect()]


def test_partitions_hold_at_most_twice_the_target(spark, monkeypatch):
    monkeypatch.setattr(L, "CELL_FILES", 100)
    target = 100_000
    # most bytes in few files of one region of the key space, many empty ones, three beyond the target
    files = spark.range(3000).select(
        F.concat(F.lit("/x/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"),
        F.when(F.col("id") < 3, 250_000).when(F.col("id") % 50 == 0, 60_000).when(F.col("id") % 3 == 0, 0)
         .when(F.col("id") == 7, None).otherwise(500).cast("long").alias("length"))
    dealt = L.balanced(files, target_bytes=target, file_cost=0)
    got = parts_of(dealt)
    assert sum(n for _, n, _, _ in got) == 3000
    big = [x for x in got if (x[3] or 0) >= target]
    assert len(big) == 3 and all(n == 1 for _, n, _, _ in big)
    assert all((b or 0) < 2 * target for _, _, b, most in got if (most or 0) < target)
    total = sum(b or 0 for _, _, b, _ in got)
    assert dealt.rdd.getNumPartitions() == -(-total // target) + 3
    assert sorted(r["path"] for r in dealt.collect()) == sorted(r["path"] for r in files.collect())


def test_running_sums_over_cells(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    whole = L.running_sums(df, "k", {"s": F.col("w")}, 1000, cell_rows=1000).collect()
    cells = L.running_sums(df, "k", {"s": F.col("w")}, 1000, cell_rows=30).collect()
    for found in (whole, cells):
        found.sort(key=lambda r: (r["s"], r["w"]))
        at = 0
        for r in found:                                   # the sums tile the total without gap or overlap
            assert r["s"] == at
            at += r["w"]


def test_few_bytes_still_use_every_core_and_empty_lists_work(spark, tree):
    files = L.list_tree(spark, tree, glob="*.pb")
    assert L.balanced(files, min_partitions=4).rdd.getNumPartitions() == 4
    got = {r["path"]: r["length"] for r in read_listed(files).collect()}
    assert got == {r["path"]: r["length"] for r in files.collect()}
    assert read_listed(files.limit(0)).count() == 0


def test_read_by_tasks_equals_the_scan(spark, sf_small):
    base = view_tree(spark, sf_small)
    opts = dict(fields=["view_id", "watch_time"])
    a = read_messages(spark, base, D.view_record(), **opts)
    b = read_messages(spark, base, D.view_record(), listing="tasks", **opts)
    assert a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    day = a.orderBy("path").first()["path"].split("/views-")[1].split("/", 1)[1][:10]
    c = read_messages(spark, base, D.view_record(), day=day, hours=[0, 5], listing="tasks", **opts)
    d = read_messages(spark, base, D.view_record(), day=day, hours=[0, 5], **opts)
    assert c.exceptAll(d).count() == d.exceptAll(c).count() == 0
    with pytest.raises(ValueError, match="listing"):
        read_messages(spark, base, D.view_record(), listing="x")

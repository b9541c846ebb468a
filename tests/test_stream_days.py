"""Streams into two tables: restarts in the middle of a batch give the same tables."""
import os
import tempfile

import pytest

from protoflow.functions import descriptors as D
from protoflow.functions.descriptors import message_class
from protoflow.streaming import ingest as IN


@pytest.fixture
def inbox():
    base = tempfile.mkdtemp(prefix="pf-inbox-")
    cls = message_class(*D.simple_message())
    for i in range(12):
        folder = f"{base}/2024/01/0{1 + i % 3}/00"
        os.makedirs(folder, exist_ok=True)
        data = cls(name=f"n{i}", quantity=i).SerializeToString()
        with open(f"{folder}/{i:02d}.pb", "wb") as f:
            f.write(b"\xff\xff" if i % 5 == 0 else data)
    return base


def run(spark, inbox, out, **kw):
    q = IN.ingest_days(spark, inbox, D.simple_message(), f"{out}/sink", f"{out}/bad", f"{out}/checkpoint",
                       max_files_per_trigger=5, **kw)
    q.awaitTermination()


def tables(spark, out):
    good = spark.read.parquet(f"{out}/sink")
    bad = spark.read.parquet(f"{out}/bad")
    assert "_error" not in good.columns and "content" not in good.columns
    return (sorted((str(r["view_date"]), r["name"], r["quantity"]) for r in good.collect()),
            sorted((str(r["view_date"]), os.path.basename(r["path"]), bytes(r["content"]), r["length"]) for r in bad.collect()))


def test_rows_and_bad_bytes_each_once(spark, inbox):
    out = tempfile.mkdtemp(prefix="pf-days-")
    run(spark, inbox, out)
    good, bad = tables(spark, out)
    assert [n for _, n, _ in good] and len(good) == 9 and sorted(q for _, _, q in good) == [1, 2, 3, 4, 6, 7, 8, 9, 11]
    assert bad == sorted((f"2024-01-0{1 + i % 3}", f"{i:02d}.pb", b"\xff\xff", 2) for i in (0, 5, 10))
    entries = IN.finished_batches(spark, f"{out}/sink")
    assert sorted(entries) == [0, 1, 2] and sum(e["rows"] for e in entries.values()) == 9
    assert sum(e["bad"] for e in entries.values()) == 3
    run(spark, inbox, out)                                       # nothing new
    assert tables(spark, out) == (good, bad) and len(IN.finished_batches(spark, f"{out}/sink")) == 3


@pytest.mark.parametrize("at", ["bad", "ledger", "after"])
def test_a_restart_in_the_middle_gives_equal_tables(spark, inbox, monkeypatch, at):
    clean, out = tempfile.mkdtemp(prefix="pf-days-"), tempfile.mkdtemp(prefix="pf-days-")
    run(spark, inbox, clean)
    calls = []

    def broken(real, hit):
        def run_or_fail(*args, **kw):
            if hit(args, kw):
                calls.append(1)
                if len(calls) == 2:                              # in the second batch
                    if at == "after":
                        real(*args, **kw)
                    raise RuntimeError("cut off")
            return real(*args, **kw)
        return run_or_fail

    if at == "bad":                                              # the good rows are written, the bad ones not
        monkeypatch.setattr(IN, "_replace", broken(IN._replace, lambda a, k: a[1].endswith("/bad")))
    else:                                                        # both are written; the entry is missing, or there
        monkeypatch.setattr(IN, "create_once", broken(IN.create_once, lambda a, k: True))
    with pytest.raises(Exception, match="cut off"):
        run(spark, inbox, out)
    monkeypatch.undo()
    run(spark, inbox, out)
    assert tables(spark, out) == tables(spark, clean)
    assert {b: (e["rows"], e["bad"]) for b, e in IN.finished_batches(spark, f"{out}/sink").items()}.keys() == {0, 1, 2}


def test_first_batch_is_bounded(spark, inbox):
    stream = IN.message_stream(spark, inbox, D.simple_message())
    plan = stream._jdf.queryExecution().logical().toString()
    assert IN.MAX_FILES == 10_000 and "binaryFile" in plan


def test_a_batch_is_listed_by_a_few_tasks(spark, inbox):
    """40 files of one batch: no task for each of them, and the session's own settings stay as they were."""
    cls = message_class(*D.simple_message())
    for i in range(40):
        with open(f"{inbox}/2024/01/01/00/more-{i:02d}.pb", "wb") as f:
            f.write(cls(name="m", quantity=i).SerializeToString())
    keys = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.streaming.fileSource.log.compactInterval")
    before = [spark.conf.get(k, None) for k in keys]
    own = IN.stream_session(spark)
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert int(own.conf.get(keys[0])) <= max(32, spark.sparkContext.defaultParallelism)
    out = tempfile.mkdtemp(prefix="pf-few-")
    q = IN.ingest_stream(spark, inbox, D.simple_message(), f"{out}/sink", f"{out}/checkpoint", glob="more-*",
                         fields=["name", "quantity"])
    q.awaitTermination()
    run_id = str(q.runId)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(run_id) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= max(32, spark.sparkContext.defaultParallelism)
    assert spark.read.parquet(f"{out}/sink").count() == 40
    assert [spark.conf.get(k, None) for k in keys] == before

"""Operators against brute force on small fixtures: sampling, view split, files,
registry, tables, streaming."""
import math
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from protoflow._session import new_scratch, scratch_dir
from protoflow.functions import descriptors as D
from protoflow.functions.api import decode, encode
from protoflow.operators.registry import (decode_registered, empty_registry, encode_registered, frame,
                                          load_registry, register_schema, save_registry, unframe)
from protoflow.operators.sampling import pick_file, sample_files
from protoflow.operators.views import populated_fields, snake_names, union_days, unpivot_fields
from protoflow.plans.tables import ingest_report, shape, table_detail, write_table
from protoflow.sources import fixtures as FX
from protoflow.sources.files import (land_raw_day, list_files, normalize_path, read_messages,
                                     with_path_partition, write_message_files)
from protoflow.streaming.ingest import ingest_stream


def _brute_sample(pdf, by, key, prop):
    import hashlib
    out = []
    for _g, grp in pdf.groupby(by, dropna=False):
        grp = grp.assign(_h=grp[key].map(lambda v: hashlib.md5(str(v).encode()).hexdigest()))
        grp = grp.sort_values(["_h", key])
        out.append(grp.head(math.floor(prop * len(grp))))
    return sorted(pd.concat(out)[key].tolist())


@pytest.mark.parametrize("bucket_rows", [1_000_000, 7])
def test_sample_equals_brute_force_also_when_groups_are_cut(spark, sf_small, bucket_rows):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "event_type")
    got = sorted(r[0] for r in sample_files(ev, 0.3, by="event_type", key="event_id",
                                            bucket_rows=bucket_rows).collect())
    assert got == _brute_sample(ev.toPandas(), "event_type", "event_id", 0.3)


def test_sample_hot_group(spark, sf_small):
    # one group holds every row: bucketed ranking must still be exact
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id").withColumn("g", F.lit("hot"))
    got = sorted(r[0] for r in sample_files(ev, 0.05, by="g", key="event_id", bucket_rows=50).collect())
    assert got == _brute_sample(ev.toPandas(), "g", "event_id", 0.05)
    assert len(got) == math.floor(0.05 * ev.count())


def test_pick_file_is_smallest_hash(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id")
    got = pick_file(ev, key="event_id").collect()
    assert len(got) == 1
    import hashlib
    best = min(ev.toPandas()["event_id"], key=lambda v: (hashlib.md5(str(v).encode()).hexdigest(), v))
    assert got[0][0] == best


def test_view_split_bounds_messages(spark, sf_small):
    rows = FX.view_rows(spark, sf_small, view_events=5)
    dec = rows.select("view_id", F.size("events").alias("n"), "events")
    assert dec.agg(F.max("n")).first()[0] == 5               # runs of five events, never more
    assert dec.count() > spark.read.parquet(f"{sf_small}/events.parquet").select("user_id").distinct().count()
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    assert dec.agg(F.sum("n")).first()[0] == ev.count()      # no event dropped or duplicated
    # every view's events are in (ts, event_id) order with 1-based sequence numbers
    for r in dec.limit(20).collect():
        seqs = [e["sequence_number"] for e in r["events"]]
        assert seqs == list(range(1, len(seqs) + 1))
        ts = [e["server_time"] for e in r["events"]]
        assert ts == sorted(ts)


@pytest.fixture(scope="module")
def tree(spark, sf_small):
    base = new_scratch(spark, "test-views")
    n, b = write_message_files(FX.view_messages(spark, sf_small), base)
    assert n > 0 and b > 0
    return base, n


def test_listing_recursive_and_filters(spark, tree):
    base, n = tree
    assert list_files(spark, base).count() == n
    assert list_files(spark, base, glob="*.pb").count() == n
    assert list_files(spark, base, recursive=False).count() == 0      # nested tree, files only
    one = list_files(spark, base).first()["path"]
    name = one.rsplit("/", 1)[-1]
    assert list_files(spark, base, contains=name).count() == 1
    assert "content" not in list_files(spark, base).columns


def test_path_partition_and_day_read(spark, tree):
    base, n = tree
    files = with_path_partition(list_files(spark, base))
    assert files.where("view_date IS NULL").count() == 0
    day = files.orderBy("path").first()
    d = day["view_date"].strftime("%Y/%m/%d")
    one_day = read_messages(spark, base, D.view_record(), day=d, fields=["view_id"])
    assert one_day.count() == files.where(F.col("view_date") == day["view_date"]).count()
    hours = read_messages(spark, base, D.view_record(), day=d, hours=[day["view_hour"]], fields=["view_id"])
    assert 1 <= hours.count() <= one_day.count()
    undated = spark.createDataFrame([("file:/x/y.pb",), ("file:/x/2024/13/45/99/y.pb",)], "path string")
    assert [tuple(r)[1:] for r in with_path_partition(undated).collect()] == [(None, None), (None, None)]


def test_normalize_path(spark):
    df = spark.createDataFrame([("store:/data/a/b.pb",)], "path string")
    assert df.select(normalize_path("path", "store:/", "/mnt/store/")).first()[0] == "/mnt/store/data/a/b.pb"


def test_land_raw_day_rerun_is_idempotent(spark, tree):
    base, n = tree
    out = new_scratch(spark, "test-raw")
    first = land_raw_day(spark, base, "*/*/*", out).count()
    again = land_raw_day(spark, base, "*/*/*", out).count()
    assert first == again == n
    days = land_raw_day(spark, base, "*/*/*", out).select("view_date").distinct().orderBy("view_date").collect()
    one = days[0][0].strftime("%Y/%m/%d")
    after = land_raw_day(spark, base, one, out)              # rerun one day: others stay
    assert after.count() == n


def test_write_table_overwrite_replaces_partitions(spark, tree):
    base, _ = tree
    views = read_messages(spark, base, D.view_record(), fields=["view_id", "watch_time"], keep=("view_date",))
    path = new_scratch(spark, "test-table")
    name = f"pf_test_{uuid.uuid4().hex[:8]}"
    write_table(views, path=path, name=name)
    write_table(views, path=path, name=name)
    assert spark.read.table(name).count() == views.count()
    det = table_detail(spark, name).first()
    assert det["num_rows"] == views.count() and det["partition_columns"] == "view_date"
    assert shape(views).first().asDict() == {"n_rows": views.count(), "n_cols": 3}


def test_registry_ids_and_framing(spark, sf_small):
    reg = empty_registry(spark)
    reg, a = register_schema(reg, "events-value", D.event_msg(1))
    reg, b = register_schema(reg, "events-value", D.event_msg(2))
    reg, a2 = register_schema(reg, "events-value", D.event_msg(1))
    assert (a, b, a2) == (1, 2, 1) and reg.count() == 2
    df = spark.createDataFrame([(bytearray(b"\x01\x02"),)], "value binary")
    un = unframe(frame(df, "value", 258), "value").first()
    assert un["_magic"] == 0 and un["_schema_id"] == 258 and bytes(un["_payload"]) == b"\x01\x02"


def test_registry_unknown_id(spark, sf_small):
    reg, _ = register_schema(empty_registry(spark), "events-value", D.event_msg(1))
    rows = FX.event_rows(spark, sf_small)
    framed = encode_registered(rows, reg, schema_id=1)
    bad = framed.withColumn("value", F.concat(F.unhex(F.lit("0000000009")), F.expr("substring(value, 6)")))
    with pytest.raises(Exception, match="not in registry"):
        decode_registered(bad, reg, D.event_msg(1)).collect()
    res = decode_registered(bad, reg, D.event_msg(1), mode="permissive")
    assert res.where("_error IS NOT NULL").count() == rows.count()


def test_registry_decode_refuses_another_message(spark, sf_small):
    reg, ev = register_schema(empty_registry(spark), "events-value", D.event_msg(1))
    reg, order = register_schema(reg, "orders-value", D.order_msg())
    rows = spark.createDataFrame([(77,)], "order_key long")
    framed = encode_registered(rows, reg, subject="orders-value")
    with pytest.raises(Exception, match="not in registry"):
        decode_registered(framed, reg, D.event_msg(1)).collect()
    assert decode_registered(framed, reg, D.order_msg()).first()["order_key"] == 77
    other = decode_registered(framed, reg, D.order_msg(), subject="events-value", mode="permissive").first()
    assert other["order_key"] is None and "not in registry" in other["_error"]


def test_registry_is_saved_and_loaded(spark):
    path = new_scratch(spark, "registry")
    reg, _ = register_schema(load_registry(spark, path), "events-value", D.event_msg(1))
    save_registry(reg, path)
    save_registry(reg, path)
    again = load_registry(spark, path)
    assert again.collect() == reg.collect()
    more, sid = register_schema(again, "events-value", D.event_msg(2))
    assert sid == 2
    save_registry(more, path)
    assert load_registry(spark, path).count() == 2
    other, _ = register_schema(empty_registry(spark), "orders-value", D.order_msg())
    with pytest.raises(ValueError, match="another schema"):
        save_registry(other, path)
    assert load_registry(spark, path).count() == 2


def test_views_helpers(spark, sf_small):
    dec = decode(FX.view_messages(spark, sf_small), D.view_record(), names="camel",
                 fields=["view_id", "custom_2", "watch_time"])
    assert snake_names(dec).columns == ["view_id", "custom_2", "watch_time"]
    pop = {r["field"]: (r["n_set"], r["n_rows"]) for r in populated_fields(dec).collect()}
    assert pop["viewId"][0] == pop["viewId"][1]
    un = unpivot_fields(dec, "viewId", ["watchTime", "custom2"])
    assert un.count() == 2 * dec.count()
    u = union_days(dec.select("viewId"), dec.select("viewId", "watchTime"))
    assert u.count() == 2 * dec.count() and u.where("watchTime IS NULL").count() == dec.count()


def test_ingest_report(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "event_type")
    chosen = sample_files(ev, 0.25, by="event_type", key="event_id")
    rep = ingest_report(ev, chosen, key="event_id").first()
    assert rep["n_found"] == ev.count() and rep["n_selected"] == chosen.count()


def test_stream_equals_batch(spark, tree):
    base, n = tree
    out = new_scratch(spark, "test-stream")
    q = ingest_stream(spark, base, D.view_record(), sink=f"{out}/sink", checkpoint=f"{out}/ckpt",
                      fields=["view_id", "watch_time"], keep=("view_date",))
    q.awaitTermination()
    streamed = spark.read.parquet(f"{out}/sink").select("view_id", "watch_time", "view_date")
    batch = read_messages(spark, base, D.view_record(), fields=["view_id", "watch_time"], keep=("view_date",))
    assert sorted(streamed.collect()) == sorted(batch.select(*streamed.columns).collect())
    # restart on the same checkpoint: nothing is processed twice
    q2 = ingest_stream(spark, base, D.view_record(), sink=f"{out}/sink", checkpoint=f"{out}/ckpt",
                       fields=["view_id", "watch_time"], keep=("view_date",))
    q2.awaitTermination()
    assert spark.read.parquet(f"{out}/sink").count() == n


def test_scratch_dir_comes_from_session(spark):
    d = scratch_dir(spark)
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    expected = conf or spark.sparkContext.getCheckpointDir()
    assert d == expected.rstrip("/")


def test_sample_tree_keeps_loose_files(spark, tree):
    from protoflow.operators.sampling import sample_tree
    base, n = tree
    day_dirs = list_files(spark, base).withColumn("_d", F.regexp_extract("path", r"(.*/\d{4}/\d{2}/\d{2})/", 1))
    day = day_dirs.orderBy("path").first()["_d"]          # a day folder: hour folders below it
    files = list_files(spark, day)
    got = sample_tree(files, day, 0.5).collect()
    pdf = files.toPandas()
    pdf["hour"] = pdf["path"].str.slice(len(day) + 1, len(day) + 3)
    expect = sum(math.floor(0.5 * c) for c in pdf.groupby("hour").size())
    assert len(got) == expect


def test_sample_tree_loose_files_kept(spark):
    from protoflow.operators.sampling import sample_tree
    base = new_scratch(spark, "test-loose")
    rel = [f"a/x{i}.pb" for i in range(3)] + [f"b/c/y{i}.pb" for i in range(4)] + ["l1.pb", "l2.pb"]
    df = spark.createDataFrame([(r, bytearray(b"\x08\x01")) for r in rel], "relpath string, value binary")
    write_message_files(df, base)
    got = sorted(r["path"].rsplit("/", 1)[-1] for r in sample_tree(list_files(spark, base), base, 0.5).collect())
    assert len(got) == 1 + 2 + 2 and "l1.pb" in got and "l2.pb" in got


def test_managed_table_rerun_replaces_only_its_days(spark, tree):
    base, _ = tree
    views = read_messages(spark, base, D.view_record(), fields=["view_id", "watch_time"], keep=("view_date",))
    path = new_scratch(spark, "test-managed")
    name = f"pf_days_{uuid.uuid4().hex[:8]}"
    write_table(views, path=path, name=name)
    first_day = views.agg(F.min("view_date")).first()[0]
    one_day = views.where(F.col("view_date") == first_day).withColumn("watch_time", F.lit(-1))
    write_table(one_day, path=path, name=name)
    t = spark.read.table(name)
    assert t.count() == views.count()
    assert t.where(F.col("watch_time") == -1).count() == one_day.count()
    assert t.where((F.col("view_date") != first_day) & (F.col("watch_time") == -1)).count() == 0


def test_field_presence_equals_decoded_counts(spark, sf_small):
    from protoflow.functions.api import field_presence
    msgs = FX.view_messages(spark, sf_small)
    fast = {r["field"]: (r["n_set"], r["n_rows"]) for r in field_presence(msgs, D.view_record()).collect()}
    dec = decode(msgs, D.view_record(), timestamp="timestamp_ntz")
    slow = {r["field"]: (r["n_set"], r["n_rows"]) for r in populated_fields(dec, exclude=()).collect()}
    assert fast == slow
    orders = FX.order_messages(spark, sf_small)                  # proto3: ordinary class
    pres = {r["field"]: r["n_set"] for r in field_presence(orders, D.order_msg()).collect()}
    assert pres["total_price"] == orders.count() and pres["attrs"] == 0


def test_registry_through_decode_and_encode_arguments(spark, sf_small):
    reg, sid = register_schema(empty_registry(spark), "events-value", D.event_msg(1))
    rows = FX.event_rows(spark, sf_small)
    framed = encode(rows, registry=reg, subject="events-value", keep=("event_id",)) \
        .withColumnRenamed("event_id", "src_id")
    out = decode(framed, D.event_msg(1), registry=reg, keep=("src_id",), fields=["event_id"])
    assert out.where("src_id <> event_id").count() == 0 and out.count() == rows.count()
    assert {r[0] for r in out.select("_schema_id").distinct().collect()} == {sid}


def test_writer_leaves_no_temp_files(spark, tree):
    import pyarrow.fs as pafs

    from protoflow._session import open_fs
    base, n = tree
    fs, root = open_fs(base)
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root, recursive=True))
             if i.type == pafs.FileType.File]
    assert len(names) == n and not [x for x in names if x.startswith(".") or x.endswith(".tmp")]


def test_frame_rejects_out_of_range_ids(spark):
    df = spark.createDataFrame([(bytearray(b"\x01"), -1)], "value binary, sid int")
    with pytest.raises(ValueError):
        frame(df, "value", -1)
    with pytest.raises(Exception, match="outside"):
        frame(df, "value", "sid").collect()
    ok = unframe(frame(df.withColumn("sid", F.lit(2**31 - 1)), "value", "sid"), "value").first()
    assert ok["_schema_id"] == 2**31 - 1

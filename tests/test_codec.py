"""Encode/decode on Spark: round trips per type, presence modes, edge cases."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protoflow.functions import descriptors as D
from protoflow.functions.api import decode, decode_json, encode, validate_required

VIEW = D.view_record()
ORDER = D.order_msg()
EVENT = D.event_msg()


def _bytes_df(spark, msgs):
    """Test helper: a few hand-built messages as a binary column."""
    return spark.createDataFrame([(i, bytearray(m.SerializePartialToString()) if m is not None else None)
                                  for i, m in enumerate(msgs)], "id int, value binary")


def test_event_roundtrip_keeps_presence(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    src = ev.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    out = decode(encode(src, EVENT), EVENT, timestamp="timestamp_ntz")
    assert sorted(out.collect()) == sorted(src.select(*out.columns).collect())
    with pytest.raises(ValueError, match="collide"):
        decode(encode(src, EVENT, keep=("event_id",)), EVENT, keep=("event_id",))


def test_presence_null_vs_default(spark):
    cls = D.message_class(*VIEW)
    unset = cls(view_id="a")
    zero = cls(view_id="b", asn=0, browser="", watched=False)
    df = _bytes_df(spark, [unset, zero])
    null = {r["view_id"]: r for r in decode(df, VIEW, fields=["view_id", "asn", "browser", "watched", "events"])
            .collect()}
    assert null["a"]["asn"] is None and null["a"]["browser"] is None and null["a"]["events"] is None
    assert null["b"]["asn"] == 0 and null["b"]["browser"] == "" and null["b"]["watched"] is False
    dflt = {r["view_id"]: r for r in decode(df, VIEW, absent="default",
                                            fields=["view_id", "asn", "browser", "events"]).collect()}
    assert dflt["a"]["asn"] == 0 and dflt["a"]["browser"] == "" and dflt["a"]["events"] == []


def test_presence_primitive_leaves_messages_and_oneofs(spark):
    cls = D.message_class(*VIEW)
    m = cls(view_id="v")
    m.events.add(type="a")
    got = decode(_bytes_df(spark, [m, None]), VIEW, keep=("id",), absent="primitive").orderBy("id").collect()
    assert got[0]["asn"] == 0 and got[0]["browser"] == "" and got[0]["view_start"] is None
    event = got[0]["events"][0]
    assert event["orientation_info"] is None and event["rendition_info"] is None
    assert got[1]["asn"] is None and got[1]["events"] is None
    order = D.message_class(*ORDER)(order_key=5)
    row = decode(_bytes_df(spark, [order]), ORDER, absent="primitive").first()
    assert row["order_key"] == 5 and row["counters"] == {} and row["attrs"] is None
    for f in D.message_descriptor(*ORDER).fields:
        if f.containing_oneof is not None:
            assert row[f.name] is None


def test_protobuf_json_mapping(spark):
    import json

    from google.protobuf import json_format

    cls = D.message_class(*ORDER)
    m = cls(order_key=5, counters={"x": 3})
    m.attrs.update({"a": 1})
    df = _bytes_df(spark, [m, None, cls()])
    rows = decode_json(df, ORDER, mapping="protobuf").orderBy("id").collect()
    got = json.loads(rows[0]["content"])
    assert got == json.loads(json_format.MessageToJson(m))
    assert got["attrs"] == {"a": 1.0} and got["counters"] == {"x": "3"}
    assert rows[1]["content"] is None and rows[2]["content"] == "{}"
    assert [r["id"] for r in rows] == [0, 1, 2] and bytes(rows[0]["value"]) == m.SerializeToString()
    proto = decode_json(df, ORDER, mapping="protobuf", names="proto", keep=("id",)).orderBy("id").first()
    assert "order_key" in json.loads(proto["content"]) and proto.asDict().keys() == {"id", "content"}
    empty = decode_json(df.limit(0), ORDER, mapping="protobuf")
    assert empty.columns == ["id", "value", "content"] and empty.count() == 0


@pytest.mark.parametrize("mapping", ["spark", "protobuf"])
def test_json_of_broken_messages(spark, mapping):
    good = D.message_class(*ORDER)(order_key=5).SerializeToString()
    df = spark.createDataFrame([(0, bytearray(good)), (1, bytearray(b"\x0a\xff"))], "id int, value binary")
    rows = decode_json(df, ORDER, mapping=mapping, mode="permissive").orderBy("id").collect()
    assert rows[0]["_error"] is None and "5" in rows[0]["content"]
    assert rows[1]["content"] is None and rows[1]["_error"]
    with pytest.raises(Exception, match="OrderMsg"):
        decode_json(df, ORDER, mapping=mapping).collect()


def test_oneof_exactly_one(spark):
    cls = D.message_class(*VIEW)
    m = cls(view_id="v")
    e1 = m.events.add(type="a")
    e1.orientation_info.x = 1.0
    e2 = m.events.add(type="b")
    e2.rendition_info.width = 5
    m.events.add(type="c")
    rows = decode(_bytes_df(spark, [m]), VIEW, fields=["events"], oneof_case=True).first()["events"]
    assert [r["info_case"] for r in rows] == ["orientation_info", "rendition_info", None]
    assert rows[0]["rendition_info"] is None and rows[1]["orientation_info"] is None
    assert rows[1]["rendition_info"]["width"] == 5 and rows[1]["rendition_info"]["height"] is None


@pytest.mark.parametrize("seconds,nanos", [(0, 0), (1, 500_000_000), (1, 999_999_999), (-2, 1_000), (2**31, 0)])
def test_timestamp_floors_to_micros(spark, seconds, nanos):
    cls = D.message_class(*VIEW)
    m = cls(view_id="t")
    m.view_start.seconds, m.view_start.nanos = seconds, nanos
    df = _bytes_df(spark, [m])
    us = decode(df, VIEW, fields=["view_start"], timestamp="timestamp_ntz") \
        .select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', view_start)")).first()[0]
    assert us == seconds * 1_000_000 + nanos // 1000
    assert decode(df, VIEW, fields=["view_start"], timestamp="epoch_seconds").first()[0] == seconds
    text = decode(df, VIEW, fields=["view_start"], timestamp="string").first()[0]
    assert text == m.view_start.ToJsonString()


def test_duration_negative_and_text(spark):
    cls = D.message_class(*VIEW)
    m = cls(view_id="d")
    e = m.events.add(type="x")
    e.playhead_time.seconds, e.playhead_time.nanos = -1, -500_000_000
    df = _bytes_df(spark, [m])
    iv = decode(df, VIEW, fields=["events.playhead_time"]).first()[0][0]["playhead_time"]
    assert iv == dt.timedelta(seconds=-1.5)
    text = decode(df, VIEW, fields=["events.playhead_time"], duration="string").first()[0][0][0]
    assert text == e.playhead_time.ToJsonString()


def test_uint64_overflow_and_decimal(spark):
    cls = D.message_class(*ORDER)
    df = _bytes_df(spark, [cls(order_key=1, order_key_u64=2**63), cls(order_key=2, order_key_u64=7)])
    with pytest.raises(Exception, match="exceeds bigint"):
        decode(df, ORDER, fields=["order_key_u64"]).collect()
    vals = sorted(r[0] for r in decode(df, ORDER, fields=["order_key_u64"], uint64="decimal").collect())
    assert vals == [Decimal(7), Decimal(2**63)]
    perm = decode(df, ORDER, fields=["order_key", "order_key_u64"], mode="permissive").collect()
    bad = [r for r in perm if r["_error"]]
    assert len(bad) == 1 and bad[0]["order_key"] is None


def test_enum_unknown_number_and_int_mode(spark):
    cls = D.message_class(*ORDER)
    m = cls(order_key=1)
    m.status = 2
    unknown = cls(order_key=2)
    unknown.status = 9                      # open (proto3) enum keeps unknown numbers
    df = _bytes_df(spark, [m, unknown])
    names = {r[0]: r[1] for r in decode(df, ORDER, fields=["order_key", "status"]).collect()}
    assert names == {1: "O", 2: "9"}
    ints = {r[0]: r[1] for r in decode(df, ORDER, fields=["order_key", "status"], enums="int").collect()}
    assert ints == {1: 2, 2: 9}


def test_bytes_are_preserved(spark):
    raw = bytes([0, 255, 254, 10, 0])
    df = spark.createDataFrame([(bytearray(raw),)], "priority_bytes binary")
    out = decode(encode(df, ORDER), ORDER, fields=["priority_bytes"]).first()[0]
    assert bytes(out) == raw


def test_wide_types_roundtrip(spark):
    schema = ("order_key long, status string, priority int, cust_key long, order_key_u64 decimal(20,0), "
              "total_price double, status_text string, neg_key long, cust_fixed long, price_f float, "
              "order_date timestamp_ntz, key_parts array<long>, counters map<string,long>, attrs string")
    row = (5, "P", 3, 4000000000, Decimal(2**64 - 1), 0.0, "", -9, 7, 1.5,
           dt.datetime(1969, 12, 31, 23, 59, 59, 500000), [1, 2, 3], {"a": 1, "b": 0}, '{"k": 1.5}')
    df = spark.createDataFrame([row], schema)
    out = decode(encode(df, ORDER), ORDER, uint64="decimal", timestamp="timestamp_ntz").first()
    assert out["status"] == "P" and out["priority"] == "MEDIUM"
    assert out["cust_key"] == 4000000000 and out["order_key_u64"] == Decimal(2**64 - 1)
    assert out["total_price"] == 0.0 and out["status_text"] == ""      # wrappers keep zero values
    assert out["neg_key"] == -9 and out["price_f"] == 1.5
    assert out["order_date"] == dt.datetime(1969, 12, 31, 23, 59, 59, 500000)
    assert out["key_parts"] == [1, 2, 3] and out["counters"] == {"a": 1, "b": 0}
    assert '"k"' in out["attrs"]


def test_corrupt_failfast_and_permissive(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    msgs = encode(ev, EVENT, keep=("event_id",)).withColumnRenamed("event_id", "src_id")
    cut = msgs.withColumn("value", F.expr("substring(value, 1, length(value) - 1)"))
    with pytest.raises(Exception, match="cannot parse"):
        decode(cut, EVENT).collect()
    res = decode(cut, EVENT, keep=("src_id",), mode="permissive")
    assert res.where("_error IS NULL").count() == 0
    assert res.where("event_type IS NOT NULL").count() == 0
    assert res.count() == ev.count()


def test_missing_required_decodes_but_is_invalid(spark):
    cls = D.message_class(*VIEW)
    m = cls(view_id="x")                     # property_id, view_start, view_end missing
    df = _bytes_df(spark, [m])
    assert decode(df, VIEW, fields=["view_id"]).first()[0] == "x"
    r = validate_required(df, VIEW, keep=("id",)).first()
    assert r["_valid"] is False
    assert set(r["_valid_missing"].split(",")) == {"property_id", "view_start", "view_end"}


def test_encode_null_required_names_the_field(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="ts"):
        encode(ev, EVENT).collect()


def test_unknown_tags_are_skipped_and_new_fields_null(spark):
    new = D.message_class(*D.video_view())(view_id="n", asset_id="A", live_stream_latency=3)
    old_reader = decode(_bytes_df(spark, [new]), VIEW, fields=["view_id"]).first()
    assert old_reader["view_id"] == "n"
    old = D.message_class(*VIEW)(view_id="o")
    r = decode(_bytes_df(spark, [old]), D.video_view(), fields=["view_id", "asset_id"]).first()
    assert r["view_id"] == "o" and r["asset_id"] is None


def test_camel_names_and_json(spark, sf_small):
    cls = D.message_class(*VIEW)
    df = _bytes_df(spark, [cls(view_id="c", custom_1="x", player_source_duration=2**40)])
    cols = decode(df, VIEW, names="camel").columns
    assert "custom1" in cols and "viewMaxPlayheadPosition" in cols
    js = decode_json(df, VIEW, keep=("id",)).first()["content"]
    assert '"custom1":"x"' in js and '"playerSourceDuration":1099511627776' in js
    quoted = decode_json(df, VIEW, keep=("id",), int64_as_string=True).first()["content"]
    assert '"playerSourceDuration":"1099511627776"' in quoted


def test_null_input_gives_null_row(spark):
    df = _bytes_df(spark, [None])
    r = decode(df, VIEW, fields=["view_id"], expanded=False, keep=("id",)).first()
    assert r["value"] is None


def test_type_override(spark):
    cls = D.message_class(*VIEW)
    m = cls(view_id="o")
    m.view_start.seconds = 86400 * 3
    out = decode(_bytes_df(spark, [m]), VIEW, fields=["view_start"],
                 type_overrides={"google.protobuf.Timestamp": (_seconds_text, T.StringType())}).first()[0]
    assert out == "259200"


def _seconds_text(ts):
    return str(ts.seconds)


def test_jvm_engine_is_guarded(spark):
    from protoflow.functions.api import jvm_protobuf_available
    df = spark.createDataFrame([(bytearray(b""),)], "value binary")
    if not jvm_protobuf_available(spark):
        with pytest.raises(RuntimeError, match="spark-protobuf"):
            decode(df, VIEW, engine="jvm")
    with pytest.raises(ValueError, match="does not support"):
        decode(df, VIEW, engine="jvm", names="camel")


def test_float_digits(spark):
    cls = D.message_class(*VIEW)
    df = _bytes_df(spark, [cls(view_id="f", latitude=3.14159265358979, max_downscale_percentage=0.123456)])
    r = decode(df, VIEW, fields=["latitude", "max_downscale_percentage"], float_digits=3).first()
    assert r["latitude"] == 3.14 and abs(r["max_downscale_percentage"] - 0.123) < 1e-7

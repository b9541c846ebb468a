"""The reference's own smoke demos, reproduced on small literal inputs."""
from pyspark.sql import types as T

from protoflow.functions import descriptors as D
from protoflow.functions.api import decode, encode
from protoflow.operators.registry import (decode_registered, empty_registry, encode_registered,
                                          register_schema)

# The demo rows of the reference notebooks.
SIMPLE_ROW = ("hello", 5, 12.3)
APP_EVENT_ROWS = [("Click", 1, "Profile"), ("Notification", 2, "New Friend"), ("Render", 3, "Leader Board")]


def test_simple_message_round_trip(spark):
    df = spark.createDataFrame([SIMPLE_ROW], "name string, quantity long, measure float")
    out = decode(encode(df, D.simple_message()), D.simple_message(), expanded=False)
    assert out.schema["value"].dataType == T.StructType([
        T.StructField("name", T.StringType()), T.StructField("quantity", T.LongType()),
        T.StructField("measure", T.FloatType())])
    row = out.select("value.*").first()
    assert (row["name"], row["quantity"]) == ("hello", 5)
    assert abs(row["measure"] - 12.3) < 1e-6


def test_app_events_through_registry(spark):
    df = spark.createDataFrame(APP_EVENT_ROWS, "name string, id long, context string")
    reg, sid = register_schema(empty_registry(spark), "app-events-value", D.app_event())
    events = df.selectExpr("struct(name, id, context) AS event")
    framed = encode_registered(events, reg, subject="app-events-value", col="event", out="value")
    collected = framed.collect()                       # the demo collects the encoded records
    assert all(bytes(r["value"])[:5] == b"\x00" + sid.to_bytes(4, "big") for r in collected)
    again = spark.createDataFrame([(r["value"],) for r in collected], "value binary")
    dec = decode_registered(again, reg, D.app_event(), expanded=False, out="proto_event")
    assert dec.schema["proto_event"].dataType.simpleString() == "struct<name:string,id:bigint,context:string>"
    got = sorted(tuple(r) for r in dec.select("proto_event.*").collect())
    assert got == sorted(APP_EVENT_ROWS)

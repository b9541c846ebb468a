"""Protobuf inputs derived by Spark from the driver's tables.

The reference's inputs were private message files; here every message is built
from ``events`` / ``orders`` rows, so the work grows with the tables:

* EventMsg  - one message per ``events`` row (``value`` unset for ``error``).
* view record - one message per view = ``VIEW_EVENTS`` consecutive events of one user
  (the last run may be shorter), in (ts, event_id) order, so no message and no group
  grows without bound even when one user holds a third of all rows.
* OrderMsg  - one message per ``orders`` row (enums, bytes, unsigned, wrappers, map).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._session import shuffle_partitions, spread
from ..functions import descriptors as D
from ..functions.api import encode

VIEW_EVENTS = 5000      # a view is a run of this many consecutive events of a user (the last may be shorter)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_input(df: DataFrame) -> DataFrame:
    """Input of a per-message Python stage: at least one partition per core."""
    return spread(df)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return python_input(ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "props"))


def event_messages(spark: SparkSession, sf_dir: str, version: int = 1, keep=()) -> DataFrame:
    """``value`` = EventMsg bytes, one per events row (+ ``keep`` columns)."""
    rows = event_rows(spark, sf_dir)
    if version >= 2:
        rows = rows.withColumn("source", F.concat(F.col("event_type"), F.lit("-src")))
    return encode(rows, D.event_msg(version), keep=keep)


def event_places(ev: DataFrame) -> DataFrame:
    """``ev`` with ``_place``: each event's place (from 0) among its user's events by (ts, event_id).

    Small counts per user and hour give the place of an hour's first event; events are then
    ranked inside their hour, so a user who holds a third of all rows is never sorted in one
    task.  Rows without a user are the events of one NULL user.
    """
    hour = F.date_trunc("hour", F.col("ts"))
    counts = ev.groupBy(F.col("user_id").alias("_u"), hour.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_u").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_u", "_h", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("user_id", "_hour").orderBy("ts", "event_id")) - 1
    placed = ev.withColumn("_hour", hour).join(
        firsts, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_hour").eqNullSafe(F.col("_h")))
    return placed.withColumn("_place", F.col("_first") + rank).drop("_u", "_h", "_first", "_hour")


def view_rows(spark: SparkSession, sf_dir: str, view_events: int = VIEW_EVENTS) -> DataFrame:
    """One row per view with the view-record fields as columns (ready for ``encode``)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                               "props")
    ev = event_places(ev).withColumn("_split", F.floor(F.col("_place") / view_events).cast("long")).drop("_place")
    # Hash-partition on the view key with the session's shuffle width: no key has more than
    # ``view_events`` rows, so no partition can be skewed, and the explicit width keeps the
    # Python encode that follows spread over all cores.
    ev = ev.repartition(shuffle_partitions(spark), "user_id", "_split")
    grouped = ev.groupBy("user_id", "_split").agg(
        F.min("ts").alias("view_start"),
        F.max("ts").alias("view_end"),
        F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("_ev"),
        F.count(F.lit(1)).cast("int").alias("watch_time"),
        F.max(F.col("event_type") == "click").alias("used_fullscreen"),
        F.max(F.col("event_type") == "view").alias("watched"),
        F.min("event_type").alias("custom_2"),
        F.max("props").alias("custom_4"),
        F.min(F.when(F.col("event_type") == "error", F.col("event_id").cast("string"))).alias("custom_5"),
        F.min("value").alias("latitude"),
        F.max("value").alias("longitude"),
        F.sum("event_id").alias("player_source_duration"),
    )
    start = F.col("view_start")
    events = F.transform(F.col("_ev"), lambda e, i: F.struct(
        (i + 1).cast("long").alias("sequence_number"),
        e["ts"].alias("server_time"),
        e["ts"].alias("viewer_time"),
        (e["ts"] - start).alias("playhead_time"),
        e["event_type"].alias("type"),
        F.when(e["event_type"] == "click",
               F.struct(e["value"].alias("x"), (-e["value"]).alias("y"),
                        e["event_id"].cast("double").alias("z"))).alias("orientation_info"),
        F.when(e["event_type"] == "view",
               F.struct(e["event_id"].alias("width"), F.col("user_id").alias("height"),
                        e["value"].alias("fps"), (e["event_id"] * 1000).alias("bitrate")))
         .alias("rendition_info"),
    ))
    uid = F.coalesce(F.col("user_id").cast("string"), F.lit("none"))
    return grouped.select(
        F.concat(uid, F.lit("-"), F.col("_split").cast("string")).alias("view_id"),
        F.concat(F.lit("property-"), F.coalesce(F.pmod(F.col("user_id"), F.lit(7)).cast("string"),
                                                F.lit("none"))).alias("property_id"),
        "view_start", "view_end",
        events.alias("events"),
        F.col("user_id").try_cast("int").alias("asn"),
        "custom_2",
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 1, F.lit("widevine")).alias("custom_3"),
        "custom_4", "custom_5", "latitude", "longitude", "player_source_duration",
        F.col("latitude").cast("float").alias("smoothness_score"),
        "used_fullscreen",
        F.col("user_id").cast("string").alias("viewer_user_id"),
        "watch_time", "watched",
    )


def relpath_of(view_start: str = "view_start", view_id: str = "view_id"):
    """``yyyy/MM/dd/HH/view-<id>.pb`` from the view's start (folder = start date/hour)."""
    return F.concat(F.date_format(F.col(view_start), "yyyy/MM/dd/HH"), F.lit("/view-"),
                    F.col(view_id), F.lit(".pb"))


def view_messages(spark: SparkSession, sf_dir: str, view_events: int = VIEW_EVENTS,
                  message=None) -> DataFrame:
    """view_id, relpath, value (view-record bytes)."""
    rows = view_rows(spark, sf_dir, view_events).withColumn("relpath", relpath_of())
    return encode(rows, message or D.view_record(), keep=("view_id", "relpath"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = python_input(table(spark, sf_dir, "orders"))
    return o.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"),
        F.col("o_custkey").alias("cust_key"),
        F.col("o_orderkey").cast("decimal(20,0)").alias("order_key_u64"),
        F.encode("o_orderpriority", "UTF-8").alias("priority_bytes"),
        F.col("o_totalprice").alias("total_price"),
        F.col("o_orderstatus").alias("status_text"),
        (-F.col("o_orderkey")).alias("neg_key"),
        F.col("o_custkey").alias("cust_fixed"),
        F.col("o_totalprice").cast("float").alias("price_f"),
        F.col("o_orderdate").alias("order_date"),
        F.array(F.col("o_orderkey"), F.col("o_custkey")).alias("key_parts"),
        F.create_map(F.lit("order"), F.col("o_orderkey"), F.lit("cust"), F.col("o_custkey")).alias("counters"),
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(order_rows(spark, sf_dir), D.order_msg(), keep=("order_key",))

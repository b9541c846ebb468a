"""Sharding by jump consistent hashing, DataFrame functions only.

A key visits increasing bucket numbers: from bucket ``b`` it jumps to
``floor((b + 1) / u(key, b))`` with ``u`` uniform in (0, 1], and it stays in the last
bucket below the shard count.  ``u`` is a hash of (key, b), so the path of a key does
not depend on the number of shards: going from n to n + 1 shards moves exactly the keys
whose path touches bucket n, and moves them there.  No ring table is kept or shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protoflow.llm._tables import ceil_div, without

CELL_ROWS = 8192


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards - 1``) of a key.  Equal keys share a shard; NULL is one key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    def step(at, _):
        uniform = (F.shiftrightunsigned(F.xxhash64(key, at["next"]), 11) + 1) / F.lit(float(1 << 53))
        onward = F.struct(at["next"].alias("bucket"),
                          F.floor((at["next"] + 1) / uniform).cast("long").alias("next"))
        return F.when(at["next"] < shards, onward).otherwise(at)

    start = F.struct(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda at: at["bucket"]).cast("int")


def shard(df: DataFrame, key: str = "doc_id", shards: int = 16, content: str | None = "text",
          cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row with ``shard``, ``slot`` (its place there, gapless from 0) and ``grown_shard``
    (its shard after one more is appended).

    Slots are counted in cells of about ``cell_rows`` rows: a shard is cut by a hash of the
    key and the content, small per-cell counts give each cell's first slot, and rows are
    ranked inside their cell only, so no task sorts a whole shard.  Rows of a NULL or
    often-repeated key share a shard (the law demands it) but not a cell, as long as their
    content differs.  Rows equal in key and content take neighbouring slots in any order.
    Columns named ``shard``, ``slot`` or ``grown_shard`` are replaced; an empty table gives
    an empty result.
    """
    df = without(df, "shard", "slot", "grown_shard")
    parts = [df[key]] + ([df[content]] if content else [])
    cells = ceil_div(df.count(), shards * cell_rows)
    order = F.xxhash64(*parts)
    placed = df.select("*", jump_hash(df[key], shards).alias("shard"),
                       jump_hash(df[key], shards + 1).alias("grown_shard"),
                       order.alias("_pf_order"), F.pmod(order, F.lit(cells)).alias("_pf_cell"))
    counts = placed.groupBy("shard", "_pf_cell").agg(F.count(F.lit(1)).alias("_pf_n"))
    before = Window.partitionBy("shard").orderBy("_pf_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_pf_shard"), F.col("_pf_cell").alias("_pf_of"),
                          F.coalesce(F.sum("_pf_n").over(before), F.lit(0)).alias("_pf_first"))
    ranked = placed.join(first, (F.col("shard") == F.col("_pf_shard")) & (F.col("_pf_cell") == F.col("_pf_of")))
    inside = F.row_number().over(Window.partitionBy("shard", "_pf_cell").orderBy("_pf_order", key))
    return ranked.withColumn("slot", F.col("_pf_first") + inside - 1).drop(
        "_pf_order", "_pf_cell", "_pf_shard", "_pf_of", "_pf_first")

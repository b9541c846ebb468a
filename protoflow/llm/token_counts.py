"""Token counts by an exact histogram of encoded lengths.

Documents are encoded once and reduced to (length, documents) before anything is shuffled;
the histogram has one row per distinct length.  Suffix sums over it answer, for every
context limit, how many documents are longer, how many tokens remain after truncation, and
where the quantiles lie.  The sums are taken in two levels (ranges of lengths, then inside a
range), so no task reads the whole histogram.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protoflow.llm._tables import ensure_shipped, only, written
from protoflow.llm._tokenize import encode_column

RANGE = 256


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", end: int | None = None) -> DataFrame:
    """(n_tokens, n_docs) over all documents.

    NULL and empty texts have the length of the end id alone (0 without one).  Repeated rows
    count each time; other columns are ignored; an empty table gives no rows.
    """
    ensure_shipped(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for _, _, ids in encode_column(tokenizer, batch.column(0), end):
                seen.update(len(x) // 4 for x in ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen.keys(), np.int64)),
                                          pa.array(np.fromiter(seen.values(), np.int64))],
                                         names=["n_tokens", "n_docs"])

    partial = only(docs, text=text).mapInArrow(run, "n_tokens long, n_docs long")
    return partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, width: int = RANGE) -> DataFrame:
    """Every distinct length as a context limit.

    ``docs_over`` / ``tokens_over``: documents longer than the limit and their tokens;
    ``tokens_within``: tokens of the others; ``tokens_truncated``: all tokens when each
    document is cut at the limit; ``quantile``: share of documents not longer.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                         F.floor(F.col("n_tokens") / width).alias("range"))
    sums = h.groupBy("range").agg(F.sum("n_docs").alias("range_docs"), F.sum("tokens").alias("range_tokens"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    above = sums.select("range", F.coalesce(F.sum("range_docs").over(after), zero).alias("above_docs"),
                        F.coalesce(F.sum("range_tokens").over(after), zero).alias("above_tokens"),
                        F.sum("range_docs").over(total).alias("all_docs"),
                        F.sum("range_tokens").over(total).alias("all_tokens"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    at = h.join(above, "range").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.col("above_docs") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_over"),
        (F.col("above_tokens") + F.coalesce(F.sum("tokens").over(inside), zero)).alias("tokens_over"))
    within = F.col("all_tokens") - F.col("tokens_over")
    return at.select("n_tokens", "n_docs", "tokens", "docs_over", "tokens_over", within.alias("tokens_within"),
                     (within + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"),
                     ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", end: int | None = None) -> DataFrame:
    """The histogram with its suffix sums, one row per distinct length."""
    return suffix_sums(written(length_histogram(docs, tokenizer, text, end), "lengths"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row (``limit``, ``tokens``): all tokens when documents are cut at any limit, seen length or not."""
    below = sums.where(F.col("n_tokens") <= limit)
    above = sums.where(F.col("n_tokens") > limit)
    kept = below.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("a"))
    cut = above.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("b"))
    both = kept.select("a", F.lit(0).alias("b")).unionByName(cut.select(F.lit(0).alias("a"), "b"))
    return both.agg(F.lit(limit).cast("long").alias("limit"), (F.sum("a") + F.sum("b") * limit).alias("tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    aggs = [F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias(f"q{i}") for i, p in enumerate(shares)]
    rows = ", ".join(f"{float(p)!r}D, q{i}" for i, p in enumerate(shares))
    return sums.agg(*aggs).select(F.expr(f"stack({len(shares)}, {rows})").alias("share", "n_tokens"))

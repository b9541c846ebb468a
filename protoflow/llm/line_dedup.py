"""Removal of lines that many sites share, DataFrame functions only.

A line is known by two hashes of its whole content.  Lines are first counted by line and site, in
tasks before the shuffle, so a line in a third of all documents is a row per site from then on.
Lines seen often enough to reach the threshold get a HyperLogLog sketch of their sites.  Where
the estimate lies within ``margin`` of the threshold the sites are counted exactly.  A
line spread over ``min_sites`` sites or more stays in the document with the smallest id
that has it and leaves every other document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protoflow.llm._tables import row_key, without, written

MIN_SITES = 3
SALTS = 16             # parts that the rows of one line are dealt to when the shared lines are joined to them
BLANK = " \t\r\x0b\x0c"


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = 0.25, lg_k: int = 10) -> DataFrame:
    """(h1, h2, first): the hashes of lines on ``min_sites`` sites or more, with the smallest id.

    ``lines`` has ``h1, h2, site, id``.  ``margin`` is over seven standard errors of a
    sketch with 2**10 registers, so only the exactly counted band can decide either way.
    """
    line = ["h1", "h2"]
    sites = written(lines.groupBy(*line, "site").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "line-sites")
    seen = sites.groupBy(*line).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    often = seen.where(F.col("n") >= min_sites).select(*line, "first")
    spread = (sites.select(*line, "site").join(often, line)
              .groupBy(*line).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("first").alias("first"))
              .select(*line, "first", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = written(spread.where(F.col("sites") >= min_sites * (1 - margin)), "line-spread")
    clear = spread.where(F.col("sites") > min_sites * (1 + margin)).select(*line, "first")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select(*line, "first")
    exact = (sites.select(*line, "site").join(near.select(*line), line)
             .groupBy(*line).agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    return clear.unionByName(near.join(exact.select(*line), line))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
               min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with shared lines removed, plus ``n_lines`` and ``n_removed``.

    Lines are the pieces between ``\\n``; those with nothing but spaces, tabs and returns
    are never counted or removed.  A NULL site is a site of its own; a NULL id sorts after
    all others.  NULL and empty texts stay as they are (``n_lines`` 0 and 1).  Equal rows
    get equal results.  Columns named ``n_lines`` or ``n_removed`` are replaced, all others
    kept; an empty table gives an empty result.
    """
    docs = without(docs, "n_lines", "n_removed")
    own = row_key(docs[key], docs[text])
    line = F.col("line")
    lines = (docs.select(own.alias("k"), docs[key].alias("id"),
                         F.coalesce(docs[site].cast("string"), F.lit("\x00")).alias("site"),
                         F.posexplode(F.split(docs[text], "\n")).alias("at", "line"))
             .where(F.length(F.btrim(line, F.lit(BLANK))) > 0)
             .select("k", "id", "site", "at", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")))
    lines = written(lines, "lines")
    shared = shared_lines(lines, min_sites)
    # the rows of a frequent line are dealt to several tasks, each with a copy of the line's one row
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("k", "at"), F.lit(SALTS)))
    copies = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = (salted.join(copies, ["h1", "h2", "salt"]).where(~F.col("id").eqNullSafe(F.col("first")))
            .groupBy("k").agg(F.collect_set("at").alias("_pf_cut"))
            .select(F.col("k").alias("_pf_k"), "_pf_cut"))
    parts = F.split(F.col(text), "\n")
    joined = (docs.withColumn("_pf_own", own).join(hits, F.col("_pf_own") == F.col("_pf_k"), "left")
              .withColumn("_pf_parts", parts))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_pf_parts") - 1), F.col("_pf_cut"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("_pf_parts"), i + 1)), "\n")
    return joined.select(
        *[F.when(F.col("_pf_cut").isNull(), F.col(c)).otherwise(rest).alias(c) if c == text else F.col(c)
          for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_pf_parts")).cast("long").alias("n_lines"),
        F.when(F.col("_pf_cut").isNull(), 0).otherwise(F.size("_pf_cut")).cast("long").alias("n_removed"))

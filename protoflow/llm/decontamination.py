"""Benchmark items found inside documents, DataFrame functions only.

Items are short and documents long, so similarity says nothing and containment is asked
for: the share of an item's distinct five-word shingles that a document has.  An item with
n shingles that lies in a document by a share ``t`` or more misses at most
``n - ceil(t n)`` of them, so one of its ``n - ceil(t n) + 1`` smallest shingle hashes must
be present.  Documents keep only the hashes below the largest that any sketch holds, and
meet the sketches in one join: the search misses nothing, and the pairs found are verified on
the shingles themselves.  Size partitions (powers of two) are nominal: the join is on the hash
alone, and one short item lifts the cut to nearly the whole hash range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protoflow.llm._tables import row_key, without, written

SPACE = "[ \\t-\\r]+"
WORDS = 5
SHARE = 0.8


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for NULL."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _windows(column: str, n: int, of) -> Column:
    w = F.col(column)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of(F.slice(w, i, n)))


def _positive(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << 63) - 1))


def item_sketches(items: DataFrame, share: float = SHARE, n: int = WORDS) -> DataFrame:
    """(item, size, part, hash): the smallest hashes of every item, by size partition."""
    hashed = items.select("item", F.array_sort(F.array_distinct(
        _windows("words", n, lambda s: _positive(F.xxhash64(s))))).alias("hashes"))
    size = F.size("hashes")
    keep = size - F.ceil(size * F.lit(share) - 1e-9).cast("int") + 1
    return (hashed.where(size > 0)
            .select("item", size.alias("size"), F.floor(F.log2(size)).cast("int").alias("part"),
                    F.explode(F.slice("hashes", F.lit(1), keep)).alias("hash")))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", share: float = SHARE, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment, _pf_k): documents holding an item by ``share`` or more.

    Texts with fewer than ``n`` words (NULL and empty ones too) have no shingles and match
    nothing.  Rows repeated with the same id and text count once; the same id with another
    text is another document, and ``_pf_k`` tells the two apart.  Items repeated under one id
    are taken as one item per text.  Other columns are ignored; empty tables give no rows.
    """
    of = items.select(items[item].alias("id"), words(items[item_text]).alias("words")).distinct()
    of = of.select(F.struct("id", F.xxhash64("words").alias("text")).alias("item"), "words")
    sketches = item_sketches(of, share, n)
    cuts = sketches.groupBy("part").agg(F.max("hash").alias("cut")).collect()   # one row per power of two
    cut = max((r["cut"] for r in cuts), default=-1)
    source = docs.select(row_key(docs[key], docs[text]).alias("k"), docs[key].alias("id"), docs[text].alias("text"))
    split = source.select("k", words(F.col("text")).alias("words"))
    hashes = split.select("k", F.explode(F.array_distinct(F.filter(
        _windows("words", n, lambda s: _positive(F.xxhash64(s))), lambda h: h <= cut))).alias("hash"))
    found = written(hashes.join(sketches.select("item", "hash"), "hash").select("k", "item").distinct(), "found")
    # Verification reads only the documents found, and compares the shingles as words.
    held = source.join(found.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    held = held.select("k", "id", words(F.col("text")).alias("words"))
    gram = lambda s: F.array_join(s, " ")
    there = held.select("k", "id", F.explode(F.array_distinct(_windows("words", n, gram))).alias("gram"))
    wanted = of.select("item", F.array_distinct(_windows("words", n, gram)).alias("grams"))
    wanted = wanted.select("item", F.size("grams").alias("n_item"), F.explode("grams").alias("gram"))
    shared = there.join(wanted, "gram").groupBy("k", "id", "item", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = shared.join(found, ["k", "item"], "left_semi").where(
        F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(share) - 1e-9))
    return enough.select(F.col("id").alias(key), F.col("item.id").alias(item), F.col("n_item").cast("long"),
                         F.col("n_shared").cast("long"),
                         (F.col("n_shared") / F.col("n_item")).alias("containment"), F.col("k").alias("_pf_k"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all columns kept; repeated rows stay or go together."""
    docs = without(docs, "_pf_k")
    bad = leaks(docs, items, key, text, **options).select(F.col("_pf_k").alias("_pf_bad")).distinct()
    return docs.join(bad, row_key(docs[key], docs[text]) == F.col("_pf_bad"), "left_anti")

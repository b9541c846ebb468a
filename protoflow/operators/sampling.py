"""Deterministic per-group sampling and single-file pick.

``sample_files`` keeps exactly ``floor(prop * n_g)`` rows of every group ``g``:
the ones with the smallest ``md5(key)`` (ties by key).  No duplicates, same
answer on every run, and equal to

    row_number() over (partition by g order by md5(key), key) <= floor(prop * n_g)

A plain window like that sorts a whole group in one task, so a group holding a
third of all rows would stall.  Instead each group is cut into hash buckets of
at most ``bucket_rows`` rows (bucket = leading md5 bits scaled by the group's
bucket count, monotone in the md5 order).  Per-bucket counts (a small table)
give each bucket's offset in the group; buckets entirely inside or outside the
first ``k`` rows are dropped before any sort, the rest are ranked inside their
bucket with a window of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._session import new_scratch, write_observed

BUCKET_ROWS = 1_000_000
_H60 = float(1 << 60)


def order_hash(key: Column, seed: int = 0) -> Column:
    """md5 of the key text (seeded): the deterministic "random" order used for sampling."""
    text = key.cast("string")
    if seed:
        text = F.concat(F.lit(f"{seed}:"), text)
    return F.md5(text)


def subdir(path: Column | str, base: str | None = None, level: int = 1) -> Column:
    """First ``level`` folders of the path below ``base`` (e.g. the hour folder of a day)."""
    p = F.col(path) if isinstance(path, str) else path
    if base is not None:
        tail = base.rstrip("/").split(":", 1)[-1].lstrip("/")
        p = F.substring_index(p, tail + "/", -1)
    return F.regexp_extract(p, "^((?:[^/]+/){%d}[^/]+)/" % (level - 1), 1)


def sample_files(df: DataFrame, prop: float, by, key: str = "path", seed: int = 0,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exactly ``floor(prop * n)`` rows per group of ``by``; deterministic; no duplicates."""
    by = [by] if isinstance(by, str) else list(by)
    h = order_hash(F.col(key), seed)
    base = df.withColumn("_h", h)
    counts = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_n",
        F.floor(F.col("_n") * F.lit(float(prop))).alias("_k"),
        F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(bucket_rows))).alias("_nb"))
    g = [f"_g{i}" for i in range(len(by))]
    counts = counts.select(*[F.col(c).alias(a) for c, a in zip(by, g)], "_n", "_k", "_nb")
    joined = base.join(counts, reduce(lambda a, b: a & b,
                                      [base[c].eqNullSafe(counts[a]) for c, a in zip(by, g)]))
    h60 = F.conv(F.substring("_h", 1, 15), 16, 10).cast("double")
    bucketed = joined.withColumn("_b", F.floor(h60 / F.lit(_H60) * F.col("_nb")).cast("long"))
    per_bucket = bucketed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    gb = g + ["_b"]
    with_off = bucketed.join(offsets.select(*[F.col(c).alias(c + "_o") for c in gb], "_off", "_c"),
                             reduce(lambda a, b: a & b,
                                    [F.col(c).eqNullSafe(F.col(c + "_o")) for c in gb]))
    # Buckets wholly past the k-th row are dropped before any sort; the remaining
    # candidate rows are ranked inside their bucket (bounded by bucket_rows) and
    # kept when their rank in the group is <= k (true for every row of a bucket
    # that lies wholly inside the first k).
    cand = with_off.where(F.col("_off") < F.col("_k"))
    rank = F.row_number().over(Window.partitionBy(*gb).orderBy("_h", key))
    kept = cand.withColumn("_r", F.col("_off") + rank).where(F.col("_r") <= F.col("_k"))
    return kept.select(*df.columns)


def pick_file(df: DataFrame, key: str = "path", seed: int = 0) -> DataFrame:
    """One row: the smallest ``md5(key)`` (a seeded, reproducible "random" pick).
    Planned as a distributed top-1 (per-partition top-k, then merge)."""
    return df.orderBy(order_hash(F.col(key), seed), F.col(key)).limit(1)


def sample_tree(files: DataFrame, base: str, prop: float, seed: int = 0,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per-folder sample of a listing below ``base``: every first-level subfolder
    contributes ``floor(prop * n)`` of its files (nested levels count toward their
    first-level parent); files lying directly in ``base`` are all kept."""
    grouped = files.withColumn("_top", subdir("path", base, level=1))
    loose = grouped.where(F.col("_top") == "")
    picked = sample_files(grouped.where(F.col("_top") != ""), prop, by="_top", key="path",
                          seed=seed, bucket_rows=bucket_rows)
    return loose.unionByName(picked).drop("_top")


# ---------------------------------------------------------------------------
# The same sample by selection: rows stay where they are
# ---------------------------------------------------------------------------
PREFIX = 3                    # hex digits of the md5 per round: 4096 counts for a group
BOUNDARY_ROWS = 1_000_000     # a group's boundary bucket is ranked in one task up to this size
CUT_ROWS = 200_000            # cuts (a row per group) are broadcast up to this number


def _keys(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(key).alias("_key"),
                     order_hash(F.col(key), seed).alias("_h"))


def _match(a: DataFrame, b: DataFrame, pairs) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[d]) for c, d in pairs])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A written table with a broadcast hint if it is small enough."""
    return F.broadcast(df) if rows <= CUT_ROWS else df


def _cuts(df: DataFrame, prop: float, by: list[str], key: str, seed: int) -> tuple[DataFrame, int, int]:
    """(g..., _hc, _kc, _take, _ties per group with a sample; groups; most rows left out of a tie).

    Counts by md5 prefix give the bucket where the k-th row of a group lies; its prefix is made
    longer, with counts of that bucket alone, until it is small enough to be ranked in one task.
    """
    spark = df.sparkSession
    g = [f"_g{i}" for i in range(len(by))]
    keys = _keys(df, by, key, seed)
    digits = PREFIX
    prefix = F.substring("_h", 1, digits)
    prefix = F.when(F.col("_h").isNull(), F.raise_error(F.lit(f"a row has no {key}"))).otherwise(prefix)
    counts = keys.groupBy(*g, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*g)
    target = counts.withColumn("_k", F.floor(F.sum("_c").over(whole) * F.lit(float(prop)))).where("_k > 0")
    upto = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def boundary(counted: DataFrame) -> tuple[DataFrame, dict]:
        """The bucket of each group that holds its k-th row, with k counted from its first row, and their sizes."""
        path = new_scratch(spark, "cuts")
        done = counted.withColumn("_upto", F.sum("_c").over(upto))
        done = (done.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k")))
                .select(*g, "_p", F.col("_c"), (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k")))
        size = write_observed(done, path, F.count(F.lit(1)).alias("n"), F.max("_c").alias("most"))
        return spark.read.schema(done.schema).parquet(path), size

    def inside(buckets: DataFrame, groups: int) -> DataFrame:
        """Group, key, hash and k of the rows in the boundary buckets; all other rows end here."""
        named = buckets.select(*[F.col(c).alias(c + "_b") for c in g], F.col("_p").alias("_pb"), "_k")
        return keys.join(_small(named, groups), _match(keys, named, [(c, c + "_b") for c in g])
                         & (F.substring("_h", 1, digits) == F.col("_pb")))

    buckets, size = boundary(target)
    groups = int(size["n"])
    while groups and size["most"] > BOUNDARY_ROWS and digits < 32:
        rows = inside(buckets, groups)
        digits = min(digits + PREFIX, 32)
        buckets, size = boundary(rows.groupBy(*g, F.substring("_h", 1, digits).alias("_p"), "_k").agg(F.count(F.lit(1)).alias("_c")))
    path = new_scratch(spark, "cut-rows")
    ranked = inside(buckets, groups).groupBy(*g, "_k", "_h", "_key").agg(F.count(F.lit(1)).alias("_ties"))
    order = Window.partitionBy(*g).orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ranked.withColumn("_upto", F.sum("_ties").over(order))
    cuts = (at.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_ties") < F.col("_k")))
            .select(*g, F.col("_h").alias("_hc"), F.col("_key").alias("_kc"),
                    (F.col("_k") - F.col("_upto") + F.col("_ties")).alias("_take"), "_ties"))
    left = write_observed(cuts, path, F.max(F.col("_ties") - F.col("_take")).alias("left"))["left"]
    return spark.read.schema(cuts.schema).parquet(path), groups, int(left or 0)


def flag_sample(df: DataFrame, prop: float, by, key: str = "path", seed: int = 0, out: str = "selected") -> DataFrame:
    """``df`` with a boolean ``out``: true for the rows that ``sample_files`` keeps.

    The md5 of the k-th row of each group is found by selection: one pass counts md5 prefixes, one
    looks at the keys of the boundary buckets, and the result is a comparison on the way: rows are
    neither shuffled nor sorted.  Both passes read only ``by`` and ``key``.  Where rows share the
    last key of a sample, as many of them are taken as are missing (these rows alone are ranked).
    NULL groups are one group; a row without a key is an error, since it has no place in the order.
    """
    return _flag(df, prop, [by] if isinstance(by, str) else list(by), key, seed, out)


def _flag(df: DataFrame, prop: float, by: list[str], key: str, seed: int, out: str) -> DataFrame:
    cuts, groups, left = _cuts(df, prop, by, key, seed)
    h = order_hash(F.col(key), seed)
    data = df.withColumn("_h", h)
    joined = data.join(_small(cuts, groups), _match(data, cuts, [(c, f"_g{i}") for i, c in enumerate(by)]), "left")
    before = (F.col("_h") < F.col("_hc")) | ((F.col("_h") == F.col("_hc")) & (F.col(key) < F.col("_kc")))
    tie = (F.col("_h") == F.col("_hc")) & (F.col(key) == F.col("_kc"))
    no = F.lit(False)
    if left == 0:
        return joined.select(*df.columns, F.coalesce(before | tie, no).alias(out))
    sure = joined.where(F.coalesce(~tie, F.lit(True))).select(*df.columns, F.coalesce(before, no).alias(out))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return sure.unionByName(joined.where(tie).withColumn(out, rank <= F.col("_take")).select(*df.columns, out))


def flag_tree(files: DataFrame, base: str, prop: float, seed: int = 0, out: str = "selected") -> DataFrame:
    """A listing with the rows of ``sample_tree`` flagged: ``floor(prop * n)`` of each first-level folder, loose files all."""
    grouped = files.withColumn("_top", subdir("path", base, level=1))
    return flag_sample(grouped, prop, by="_top", seed=seed, out=out) \
        .withColumn(out, F.col(out) | (F.col("_top") == "")).drop("_top")

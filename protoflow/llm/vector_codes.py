"""Vectors as short codes: a codebook per part of the vector, nearest entries found in a GNAT.

A vector of integers is cut into equal parts; each part is replaced by the index of the
nearest entry of that part's codebook.  The entries of a codebook stand in a geometric
near-neighbour access tree (GNAT): a node holds split points and, for every pair of a split
point and a child, the range of their distances.  The distance of a query to one split point
then rules out every child whose range lies strictly beyond the best distance so far, with
its whole subtree.  Ranges and radii are rounded outwards, so a child that could hold a tie is
always opened; the winner is decided on exact integer squared distances, ties by lower index.

Rounds of re-centring are sums by (part, entry): added up in each task first, then by an
aggregation; only the codebooks (parts x entries, a fixed size) reach the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protoflow.llm._tables import ensure_shipped, only, written

SCALE = 256
LIMIT = 1 << 24          # integer components beyond it would let an error leave the range of a long
FAN = 8                  # split points of a GNAT node
SLACK = 1e-12            # far above the rounding of a square root and a difference in doubles
HOT_SHARE = 1000         # a label of more than one row in so many is joined apart
NONE = np.iinfo(np.int64).max


def _squared(q: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = q - point
    return (apart * apart).sum(axis=1)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


class Gnat:
    """A tree over the rows of ``points`` (integers); ``ids`` are the numbers they answer with."""

    def __init__(self, points: np.ndarray, ids: np.ndarray | None = None, fan: int = FAN):
        self.ids = np.arange(len(points)) if ids is None else ids
        self.points = points
        self.children: list = []
        if len(points) <= fan:                                   # a leaf: every point is a split point
            return
        chosen = [0]                                             # farthest first, the lower id on ties
        least = _squared(points, points[0])
        while len(chosen) < fan:
            least[chosen] = -1
            chosen.append(int(least.argmax()))
            least = np.minimum(least, _squared(points, points[chosen[-1]]))
        squared = np.stack([_squared(points, points[c]) for c in chosen])
        owner = squared.argmin(axis=0)
        owner[chosen] = np.arange(fan)
        rest = np.ones(len(points), bool)
        rest[chosen] = False
        member = owner[None, :] == np.arange(fan)[:, None]       # child x point, split points included
        self.low = np.stack([_below(np.where(member, row, NONE).min(axis=1)) for row in squared])
        self.high = np.stack([_above(np.where(member, row, -1).max(axis=1)) for row in squared])
        for j in range(fan):
            mine = np.flatnonzero(member[j] & rest)
            self.children.append(Gnat(points[mine], self.ids[mine], fan) if len(mine) else None)
        self.points, self.ids = points[chosen], self.ids[chosen]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(id, squared distance) of the nearest point of every query, and how many distances it took."""
        best = np.full(len(queries), NONE, np.int64)
        where = np.full(len(queries), NONE, np.int64)
        count = self._visit(queries, np.arange(len(queries)), best, where)
        return where, best, count

    def _visit(self, queries, rows, best, where) -> int:
        alive = np.ones((len(self.ids), len(rows)), bool)
        count = 0
        for i, point in enumerate(self.points):
            at = np.flatnonzero(alive[i])
            if not len(at):
                continue
            r = rows[at]
            squared = _squared(queries[r], point)
            count += len(r)
            known = best[r]
            wins = (squared < known) | ((squared == known) & (self.ids[i] < where[r]))
            best[r[wins]], where[r[wins]] = squared[wins], self.ids[i]
            if self.children:
                near, far, radius = _below(squared), _above(squared), _above(best[r])
                for j in range(len(self.ids)):
                    dead = (near - self.high[i, j] > radius) | (self.low[i, j] - far > radius)
                    alive[j, at[dead]] = False
        for j, child in enumerate(self.children):
            if child is not None and alive[j].any():
                count += child._visit(queries, rows[alive[j]], best, where)
        return count


class Codebooks:
    """``entries[part]`` is an array (entries, width) of integers; ``width`` components a part."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.parts = len(entries)
        self.width = entries[0].shape[1]

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _integers(batches, scale: int):
    """Arrow batches (key, label, vector) -> (key, label, v): vectors with a NULL or non-finite
    component go; ``v`` is NULL if a component lies outside the limit."""
    import pyarrow as pa

    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets, np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values.slice(0, 0)
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        known = np.asarray(flat.is_valid())
        value = np.where(known, np.asarray(flat.fill_null(0)).astype(np.float64), np.nan)
        bad = np.bincount(row[~np.isfinite(value)], minlength=len(lists)) > 0
        value = np.floor(np.where(np.isfinite(value), value, 0.0) * scale)
        wide = np.bincount(row[np.abs(value) > LIMIT], minlength=len(lists)) > 0
        value = np.where(np.abs(value) > LIMIT, 0, value).astype(np.int32)
        vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value),
                                           mask=pa.array(wide) if len(lists) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors],
                                         names=["key", "label", "v"]).filter(pa.array(~bad))


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    scale: int = SCALE) -> DataFrame:
    """(key, label, v): ``v`` holds floor(scale * x) of every component, written to the shared folder.

    Rows whose vector is NULL or holds a NULL, NaN or infinite component are dropped.  ``v`` is
    NULL where a component exceeds 2^24 in size.
    """
    ensure_shipped(df.sparkSession)
    src = only(df, key=key, label=label, vector=vector)
    schema = src.select("key", "label").schema.add("v", T.ArrayType(T.IntegerType()))
    return written(src.mapInArrow(partial(_integers, scale=scale), schema), "vectors")


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column whose lists all have ``dim`` values."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dim)


def _split(matrix: np.ndarray, books: Codebooks) -> list[np.ndarray]:
    return [np.ascontiguousarray(matrix[:, p * books.width:(p + 1) * books.width]) for p in range(books.parts)]


def _sums(batches, books: Codebooks):
    """Per task: (part, entry, n, sums) of the vectors nearest to every entry."""
    import pyarrow as pa

    trees = books.trees()
    n = [np.zeros(len(e), np.int64) for e in books.entries]
    total = [np.zeros(e.shape, np.int64) for e in books.entries]
    for batch in batches:
        for p, q in enumerate(_split(_matrix(batch.column(0), books.parts * books.width), books)):
            at, _, _ = trees[p].nearest(q)
            n[p] += np.bincount(at, minlength=len(n[p]))
            np.add.at(total[p], at, q)
    rows = [(p, e, int(n[p][e]), total[p][e].tolist()) for p in range(books.parts) for e in np.flatnonzero(n[p]).tolist()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(),
                                                                  pa.list_(pa.int64())))],
        names=["part", "entry", "n", "sums"])


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where(F.col("v").isNotNull() & (F.size("v") == dim))


def dimension(vectors: DataFrame, parts: int) -> int | None:
    """The most frequent length (the larger on a tie) that ``parts`` divides; None if there is none."""
    size = F.size("v").alias("dim")
    found = (vectors.where(F.col("v").isNotNull()).groupBy(size).agg(F.count(F.lit(1)).alias("n"))
             .where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
             .orderBy(F.desc("n"), F.desc("dim")).select("dim").first())
    return found and found[0]


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks over all vectors of the table's dimension, starting from the smallest keys.

    Equal keys are taken in the order of their vectors; rows without a key start no entry; with
    fewer rows than ``entries`` the codebooks are shorter; None if there is no row to start from.
    Each round is one pass over all vectors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: an index is two hex digits")
    dim = dimension(vectors, parts)
    if dim is None:
        return None
    usable = _usable(vectors, dim)
    first = usable.where(F.col("key").isNotNull()).orderBy("key", "v").limit(entries).select("v").collect()
    if not first:
        return None
    start = np.array([r["v"] for r in first], np.int64)
    width = dim // parts
    books = Codebooks([start[:, p * width:(p + 1) * width].copy() for p in range(parts)])
    for _ in range(rounds):
        found = (usable.select("v").mapInArrow(partial(_sums, books=books),
                                               "part int, entry int, n long, sums array<long>")
                 .groupBy("part", "entry")
                 .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")))
        moved = [e.copy() for e in books.entries]
        for r in found.collect():                                # at most parts x entries rows
            moved[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
        books = Codebooks(moved)
    return books


def _codes(batches, books: Codebooks):
    """(key, label, v) -> (key, label, code, error); both NULL for vectors of another dimension."""
    import pyarrow as pa
    import pyarrow.compute as pc

    trees, dim = books.trees(), books.parts * books.width
    for batch in batches:
        fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(batch.column(2)), dim), False))
        q = _split(_matrix(batch.column(2).filter(pa.array(fits)), dim), books)
        index = np.zeros((int(fits.sum()), books.parts), np.uint8)
        error = np.zeros(len(index), np.int64)
        for p, part in enumerate(q):
            at, squared, _ = trees[p].nearest(part)
            index[:, p] = at
            error += squared
        text, step = index.tobytes().hex(), 2 * books.parts
        place = pa.array(np.cumsum(fits) - 1, mask=~fits)
        code = pa.array([text[i * step:(i + 1) * step] for i in range(len(index))], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), code.take(place), pa.array(error).take(place)],
            names=["key", "label", "code", "error"])


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """(key, label, code, error) of every row of ``vectors``; one pass, no shuffle."""
    if books is None:
        return vectors.select("key", "label", F.lit(None).cast("string").alias("code"),
                              F.lit(None).cast("long").alias("error"))
    schema = vectors.select("key", "label").schema.add("code", "string").add("error", "long")
    return vectors.mapInArrow(partial(_codes, books=books), schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over equal labels (NULL labels are one).

    Labels holding more than a thousandth of all rows are at most a thousand: their sums are
    broadcast.  The others are joined by key, so no task gets more than a thousandth of the rows.
    """
    coded = written(coded, "codes")
    sums = written(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")),
                   "label-errors")
    n = sums.agg(F.sum("n")).first()[0] or 0
    sums = sums.withColumnRenamed("label", "_label")
    hot = F.broadcast(sums.where(F.col("n") * HOT_SHARE >= n).drop("n"))
    cold = sums.where(F.col("n") * HOT_SHARE < n).drop("n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    columns = [*coded.columns, "label_error"]
    return (coded.join(hot, same).select(*columns)
            .unionByName(coded.join(hot, same, "left_anti").join(cold, same).select(*columns)))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256), one row per row with a finite vector.

    Vectors that are NULL or hold NULL, NaN or infinite components are dropped.  Vectors of
    another length than the table's, or with a component beyond 2^24 / 256, keep their row with a
    NULL code and error and take no part in the codebooks.  A NULL key is coded like any other;
    repeated rows are coded each; other columns are ignored; an empty table gives no rows.
    """
    vectors = integer_vectors(df, key, vector, label)
    books = fit(vectors, parts, entries, rounds)
    out = with_label_error(encode(vectors, books))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return out.withColumn("codebooks_sha256", digest).withColumnRenamed("key", key)

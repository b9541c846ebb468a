"""Token ids in Simple-8b words.

A word of 64 bits has a selector in its top four bits and, in the other sixty, as many ids
as its selector's width allows (60 of one bit ... 1 of sixty).  Selector 0 is the escape:
the next word is one id of more than sixty bits.  Ids are cut into blocks of a fixed number;
each block starts at a word, and the index has the first word of every block, so blocks are
decoded on their own and all words of a selector at once.

A file is a table of segments, written by Spark's own committer into any folder that Spark
can write: (part, segment, before, n_ids, words, block_words, doc_ids, doc_lengths), where
``before`` counts the ids of the part ahead of the segment.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protoflow.llm._tables import ensure_shipped, only
from protoflow.llm._tokenize import encode_column

COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])     # ids in a word, by selector
WIDTHS = np.array([64] + [60 // int(n) for n in COUNTS[1:]])
BLOCK = 1024
SEGMENT = 1 << 20
_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    for shift in range(0, 64, 16):                        # sixteen bits at a time, highest non-zero part wins
        part = ids >> np.uint64(shift)
        if not part.any():
            break
        part &= np.uint64(0xFFFF)
        out = np.where(part > 0, _BITS[part] + np.uint8(shift), out) if shift else _BITS[part]
    return out


def _choices(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selector, ids taken) for a word that would start at each id of zero-padded blocks."""
    most = {1: bits}                                      # largest width among the next k ids

    def over(k: int) -> np.ndarray:
        if k not in most:
            half = over((k + 1) // 2)
            shift = k - (k + 1) // 2
            out = half.copy()
            np.maximum(half[:-shift], half[shift:], out=out[:-shift])
            most[k] = out
        return most[k]

    selector, taken = np.zeros(len(bits), np.uint8), np.ones(len(bits), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = over(int(COUNTS[s])) <= WIDTHS[s]
        if not fits.any():
            break
        np.copyto(selector, s, where=fits)
        np.copyto(taken, np.uint8(COUNTS[s]), where=fits)
    return selector, taken


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks, wide = -(-n // block), block + 64             # a block is followed by zeros: its last word may be short
    grid = np.zeros((blocks, wide), np.uint64)
    grid[:n // block, :block] = ids[:n // block * block].reshape(-1, block)
    if n % block:
        grid[-1, :n % block] = ids[n // block * block:]
    flat = grid.ravel()
    selector, taken = _choices(_bit_lengths(flat))
    firsts = np.arange(blocks) * wide
    at, end, begin = firsts, firsts + np.minimum(block, n - np.arange(blocks) * block), []
    while len(at):                                        # the next word of every block that has one
        begin.append(at)
        at = at + taken[at]
        more = at < end
        at, end = at[more], end[more]
    begin = np.sort(np.concatenate(begin))
    kind = selector[begin]
    escaped = kind == 0
    place = np.arange(len(begin)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(begin) + int(np.count_nonzero(escaped)), np.uint64)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == s)
        if len(mine):
            at = begin[mine]
            word = flat[at] | np.uint64(s << 60)
            for j in range(1, int(COUNTS[s])):
                word |= flat[at + j] << np.uint64(j * int(WIDTHS[s]))
            words[place[mine]] = word
    raw = np.flatnonzero(escaped)
    words[place[raw] + 1] = flat[begin[raw]]
    return words, place[np.searchsorted(begin, firsts)].astype(np.uint32)


def decode(words: np.ndarray, block_words: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of a segment."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    kind = (words >> np.uint64(60)).astype(np.uint8)
    is_raw = np.zeros(len(words), bool)                   # words that hold an escaped id
    if (kind == 0).any():
        i = 0
        zeros = np.flatnonzero(kind == 0)
        while i < len(zeros):                             # an escape's own word may look like one
            is_raw[zeros[i] + 1] = True
            i = int(np.searchsorted(zeros, zeros[i] + 2))
    heads = np.flatnonzero(~is_raw)
    kind = kind[heads]
    size = COUNTS[kind]
    block_of = np.searchsorted(block_words, heads, side="right") - 1
    ahead = np.cumsum(size) - size
    first = ahead[np.searchsorted(heads, block_words)]
    start = block_of * block + ahead - first[block_of]
    end = np.minimum((block_of + 1) * block, n)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero(kind == s)
        if not len(mine):
            continue
        take, width = int(COUNTS[s]), int(WIDTHS[s])
        shifts = (np.arange(take) * width).astype(np.uint64)
        values = words[heads[mine]][:, None] >> shifts & np.uint64((1 << width) - 1)
        to = start[mine][:, None] + np.arange(take)
        keep = to < end[mine][:, None]
        out[to[keep]] = values[keep]
    raw = np.flatnonzero(kind == 0)
    out[start[raw]] = words[heads[raw] + 1]
    return out


SEGMENTS = ("part int, segment int, before long, n_ids long, words binary, block_words binary, "
            "doc_lengths array<long>, doc_ids array<{}>")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode all documents, in ascending key order, into segment files under ``path``.

    NULL keys come first; NULL and empty texts are the end id alone; rows with one key keep
    together in any order.  An empty table writes no segments.
    """
    ensure_shipped(docs.sparkSession)
    src = only(docs, key=key, text=text)
    kind = src.schema["key"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, segment, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, size = [], [], 0

        def flush():
            nonlocal segment, before, keys, ids, size
            flat = np.frombuffer(b"".join(ids), "<u4")
            words, blocks = encode(flat)
            row = pa.RecordBatch.from_pylist([{
                "part": part, "segment": segment, "before": before, "n_ids": len(flat),
                "words": words.astype("<u8").tobytes(), "block_words": blocks.astype("<u4").tobytes(),
                "doc_lengths": [len(x) // 4 for x in ids], "doc_ids": keys}], schema=schema)
            segment, before, keys, ids, size = segment + 1, before + len(flat), [], [], 0
            return row

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()),
                                    ("n_ids", pa.int64()), ("words", pa.binary()), ("block_words", pa.binary()),
                                    ("doc_lengths", pa.list_(pa.int64())),
                                    ("doc_ids", pa.list_(batch.schema.field(0).type))])
            names = batch.column(0).to_pylist()
            for a, b, encoded in encode_column(tokenizer, batch.column(1), end):
                for k, x in zip(names[a:b], encoded):
                    keys.append(k)
                    ids.append(x)
                    size += len(x) // 4
                    if size >= SEGMENT:
                        yield flush()
        if keys:
            yield flush()

    ordered = src.repartitionByRange(parts, "key").sortWithinPartitions("key")
    ordered.mapInArrow(run, SEGMENTS.format(kind)).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the files; ``start`` counts the
    ids of all documents before it, ``ids`` are little-endian unsigned 32-bit bytes."""
    ensure_shipped(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    columns = ["part", "key", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                at = {n: batch.column(n)[row] for n in batch.schema.names}
                flat = decode(np.frombuffer(at["words"].as_buffer(), "<u8"),
                              np.frombuffer(at["block_words"].as_buffer(), "<u4"), at["n_ids"].as_py()).astype("<u4")
                sizes = at["doc_lengths"].values.to_numpy()
                starts = np.cumsum(sizes) - sizes
                data = flat.tobytes()
                texts = [data[4 * a:4 * (a + n)] for a, n in zip(starts.tolist(), sizes.tolist())]
                out = [pa.array(np.full(len(sizes), at["part"].as_py(), np.int32)), at["doc_ids"].values,
                       pa.array(starts + at["before"].as_py()), pa.array(sizes),
                       pa.array([zlib.crc32(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.binary())] * ids, names=columns)

    schema = f"part int, key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    docs = files.mapInArrow(run, schema)
    # One row per part: the ids of all parts before it.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(F.col("part").alias("_pf_part"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pf_first"))
    placed = docs.join(firsts, F.col("part") == F.col("_pf_part"))
    return placed.select(F.col("key").alias(key), (F.col("start") + F.col("_pf_first")).alias("start"),
                         "n_tokens", "ids_crc32", *(["ids"] * ids))

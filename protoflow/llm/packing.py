"""Packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence are cut into full pieces and a rest; all others stay
whole.  Pieces are dealt by a hash into cells of bounded size, and each cell is packed in one
task by linear grouping: large lengths, sorted, fall into groups of equal cardinality and
are rounded up to the largest of their group; configurations of the few rounded sizes are
chosen to fill sequences as far as possible; actual pieces replace the rounded sizes; small
pieces then go best-fit, largest first, into the room that is left.  A cell loses a
sequence or two against one global packing, in return for no step that sees all pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protoflow.llm._tables import ceil_div, ensure_shipped, only
from protoflow.llm._tokenize import encode_column, release
from protoflow.llm._words import give_back

LENGTH = 4096
LARGE = 8              # pieces over 1/8 of a sequence are large
GROUPS = 512
CELL_BYTES = 16 << 20  # text bytes of a cell; its ids take about as many bytes in the task


def pieces(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids): ids as little-endian unsigned 32-bit bytes."""
    ensure_shipped(docs.sparkSession)
    src = only(docs, key=key, text=text)
    schema = src.drop("text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")

    def run(batches):
        import pyarrow as pa

        give_back()
        for batch in batches:
            for a, _, encoded in encode_column(tokenizer, batch.column(1), end):
                row, piece, start, size, ids = [], [], [], [], []
                for i, x in enumerate(encoded):
                    for p in range(0, len(x), length * 4):
                        part = x[p:p + length * 4]
                        row.append(a + i)
                        piece.append(p // (length * 4))
                        start.append(p // 4)
                        size.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                    names=["key", "piece", "start", "length", "ids"])

    return src.mapInArrow(run, schema)


def configuration(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (descending, bounded by ``counts``) fill ``room`` furthest, one of the
    largest included.  Reachable sums are the bits of an integer, one layer per size."""
    first = next(i for i, n in enumerate(counts) if n)
    left = room - sizes[first]
    mask = (1 << (left + 1)) - 1
    layers = [1]
    for i, s in enumerate(sizes):
        have = layers[-1]
        if have >> left & 1:                              # filled to the brim already
            break
        for _ in range(min(counts[i] - (i == first), left // s)):
            more = (have | have << s) & mask
            if more == have:
                break
            have = more
        layers.append(have)
    best = layers[-1].bit_length() - 1
    used = [0] * len(sizes)
    used[first] = 1
    for i in range(len(layers) - 2, -1, -1):
        while not layers[i] >> best & 1:
            best -= sizes[i]
            used[i] += 1
    return used


class _Open:
    """Open sequences by the room left in them; the tightest that fits is found by its lowest bit."""

    def __init__(self, length: int):
        self.rooms: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask = 0

    def add(self, bin_no: int, room: int) -> None:
        if room:
            self.rooms[room].append(bin_no)
            self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fit = self.mask >> size
        if not fit:
            return None
        room = size + (fit & -fit).bit_length() - 1
        bin_no = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask ^= 1 << room
        return bin_no, room


def pack_lengths(lengths: np.ndarray, length: int = LENGTH, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of every length, sequences of at most ``length``."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    big = order[lengths[order] > length // LARGE]
    small = order[len(big):]
    opened, bins = _Open(length), 0

    def place(items: list[int], at: int, begin: int) -> int:
        for i in items:
            seq[i], offset[i] = at, begin
            begin += int(lengths[i])
        return begin

    full = int(np.count_nonzero(lengths[big] == length))
    for i in big[:full]:
        seq[i] = bins
        bins += 1
    rest = [g.tolist() for g in np.array_split(big[full:], min(groups, max(1, len(big) - full))) if len(g)]
    sizes = [int(lengths[g[0]]) for g in rest]            # rounded up to the largest of the group
    counts = [len(g) for g in rest]
    while any(counts):
        used = configuration(sizes, counts, length)
        for _ in range(min(counts[i] // n for i, n in enumerate(used) if n)):
            items = [rest[i].pop() for i, n in enumerate(used) for _ in range(n)]
            opened.add(bins, length - place(items, bins, 0))
            bins += 1
        counts = [len(g) for g in rest]
    for i in small.tolist():
        size = int(lengths[i])
        found = opened.take(size)
        if found is None:
            found = bins, length
            bins += 1
        at, room = found
        place([i], at, length - room)
        opened.add(at, room - size)
    return seq, offset


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH, key: str = "doc_id", text: str = "text",
         cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset): every piece in its sequence.

    Offsets in a sequence are gapless from 0.  NULL and empty texts are the end id alone.
    Repeated rows are packed each time; NULL keys are kept.  Pieces are dealt to cells by key,
    piece and ids, so copies under other ids spread.  Other columns are ignored; an empty table
    gives no rows.
    """
    cut = pieces(docs, tokenizer, end, length, key, text)
    total = only(docs, text=text).agg(F.sum(F.octet_length("text") + 1)).collect()[0][0] or 0
    cells = ceil_div(total, cell_bytes)
    dealt = cut.withColumn("cell", F.pmod(F.xxhash64("key", "piece", F.crc32("ids")), F.lit(cells)))
    schema = cut.select("*").schema.add("sequence_id", "long").add("offset", "long")

    def run(group):
        import pyarrow as pa

        release()
        give_back()
        seq, offset = pack_lengths(group.column("length").to_numpy(), length)
        first = int(group.column("cell")[0].as_py()) << 32
        return (group.drop_columns(["cell"]).append_column("sequence_id", pa.array(seq + first))
                .append_column("offset", pa.array(offset)))

    return dealt.groupBy("cell").applyInArrow(run, schema).withColumnRenamed("key", key)

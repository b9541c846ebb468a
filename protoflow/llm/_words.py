"""Word hashes of byte strings with numpy, for use inside tasks.

Words are runs of bytes other than space and 0x09-0x0D; the work is done in slices of a
couple of megabytes that end at white space, so a very long text costs eight bytes a word
and not eight bytes a byte.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None     # of glibc alone
SLICE = 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finalizer (shift, xor, multiply) over an array of unsigned longs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words in one slice."""
    space = IS_SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return np.zeros(0, np.uint64), start
    inside = np.flatnonzero(~space)
    first = np.flatnonzero(begin[inside])
    size = np.diff(np.append(first, len(inside)))
    at = np.arange(len(inside)) - np.repeat(first, size)
    value = _BYTE[data[inside]] * _powers(int(size.max()))[at]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64)), start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``, in order."""
    array = np.frombuffer(data, np.uint8)
    if len(array) <= SLICE:
        return _slice_hashes(array)
    hashes, starts, at = [], [], 0
    while at < len(array):
        end = min(at + SLICE, len(array))
        while end < len(array) and not IS_SPACE[array[end]]:     # to the end of a word
            more = np.flatnonzero(IS_SPACE[array[end:end + SLICE]])
            end = end + int(more[0]) if len(more) else min(end + SLICE, len(array))
        h, s = _slice_hashes(array[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def grouped(texts: list[bytes], limit: int = SLICE, most: int | None = None):
    """Index ranges of consecutive texts with at most ``limit`` bytes together (one text at least), and at most
    ``most`` texts where a step takes memory per text."""
    yield from _spans([len(t) for t in texts], limit, most)


def _spans(sizes: list[int], limit: int, most: int | None):
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > limit or i - begin == most):
            yield begin, i
            begin, total = i, 0
        total += size + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def column_groups(column, limit: int = SLICE, most: int | None = None):
    """(first row, last row, part) of an Arrow string column, cut as ``grouped`` does: only the texts of a part need leave
    Arrow, and what is freed meanwhile is given back when the column has ended."""
    import pyarrow.compute as pc

    for a, b in _spans(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit, most):
        yield a, b, column.slice(a, b - a)
    give_back()


def group_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, text number of each word, first word of each text) of several texts."""
    data = b"\n".join(texts)
    h, start = word_hashes(data)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, bounds)
    return h, np.repeat(np.arange(len(texts)), np.diff(first)), first


def windows(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, place of its first word) of every ``n`` words in a row of one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1:])
    out = h[at]
    for i in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + i]
    return mix64(out), at


def give_back() -> None:
    """Return memory that this worker has freed to the system; Arrow's pool and the C library keep it else, and a reused
    worker holds the peaks of all it has done before."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def texts_of(column, lower: bool = False) -> list[bytes]:
    """The texts of an Arrow string column as bytes; NULL is empty."""
    import pyarrow as pa

    out = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    return [t.translate(LOWER) for t in out] if lower else out

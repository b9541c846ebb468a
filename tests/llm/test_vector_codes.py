"""Vector codes against plain nearest entries, and on odd tables."""
import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protoflow.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, Error string"


def brute(rows, parts, entries, rounds):
    """[(vec_id, code, error, label_error)] and the digest, with plain Python integers."""
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted((i for i, r in enumerate(kept) if r[0] is not None), key=lambda i: (kept[i][0], kept[i][1]))
    books = [[list(cut[i][p]) for i in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], book)[1]].append(c[p])
            books[p] = [[sum(z) // len(mine[j]) for z in zip(*mine[j])] if j in mine else e for j, e in enumerate(book)]
    out, per = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
        per[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per[lab]) for i, c, e, lab in out), key=repr), digest


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    # coarse values give ties and repeated vectors
    rows = [(i, (rng.integers(-6, 7, dim) / 32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    return [(i, v, None if lab == 3 else lab) for i, v, lab in rows]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 90), st.integers(1, 12), st.integers(0, 10**6))
def test_gnat_is_exact(width, n, spread, seed):
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-2 * spread, 2 * spread + 1, (200, width))
    full = ((queries[:, None, :] - points[None]) ** 2).sum(2)
    at, squared, _ = V.Gnat(points, fan=4).nearest(queries)
    assert (at == full.argmin(1)).all() and (squared == full.min(1)).all()


def test_gnat_opens_few_and_large_values_stay_exact():
    rng = np.random.default_rng(3)
    points = rng.integers(-V.LIMIT, V.LIMIT, (64, 2))
    queries = np.concatenate([points, points + 1, rng.integers(-V.LIMIT, V.LIMIT, (500, 2))])
    at, squared, count = V.Gnat(points).nearest(queries)
    full = ((queries[:, None, :] - points[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (squared == full.min(1)).all()
    assert count < len(queries) * 32


def test_codes_equal_brute_force(spark):
    rows = vectors(300, 8, 1)
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (900, None, 1), (901, [None] + [0.0] * 7, 1),
             (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = V.compress(df, parts=4, entries=16).collect()
    want, digest = brute(rows, 4, 16, 2)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_odd_lengths_wide_components_and_empty_tables(spark):
    rows = vectors(40, 8, 2) + [(50, [0.5] * 4, 0), (51, [], 0), (52, [1e30] + [0.0] * 7, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["vec_id"]: r for r in V.compress(df, parts=4, entries=64).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(got[i]["code"] is None and got[i]["error"] is None for i in (50, 51, 52))
    want, digest = brute(rows[:40], 4, 64, 2)                  # fewer rows than entries
    assert [(i, got[i]["code"], got[i]["error"]) for i in range(40)] == [w[:3] for w in sorted(want)]
    assert got[0]["codebooks_sha256"] == digest
    assert V.compress(df.limit(0), parts=4).count() == 0
    none = V.compress(df.where("vec_id = 51"), parts=4).collect()
    assert none[0]["code"] is None and none[0]["codebooks_sha256"] is None


def test_rare_and_frequent_labels_join_alike(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT_SHARE", 3)                     # one label in the broadcast, the rest by key
    rows = [(i, [i / 64, 0.0], 0 if i % 2 else i) for i in range(60)]
    got = V.compress(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), parts=2, entries=4).collect()
    want, _ = brute(rows, 2, 4, 2)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted(want)


def test_entries_fit_two_digits(spark):
    with pytest.raises(ValueError, match="two hex digits"):
        V.fit(V.integer_vectors(spark.createDataFrame([(0, [0.0], 0, "", "")], SCHEMA)), entries=257)

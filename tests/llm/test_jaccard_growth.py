"""The similarity join's work grows with the table where a family of near copies is not linked."""
import random

from protoflow.llm import jaccard_join
from tests.llm.test_operators import brute_components


def recorded(monkeypatch):
    """Frames by the name they are written under, as (plan before writing, frame read back)."""
    frames, write = {}, jaccard_join.written

    def keep(df, kind, *args):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, kind, *args)
        frames.setdefault(kind, []).append((plan, out))
        return out

    monkeypatch.setattr(jaccard_join, "written", keep)
    return frames


def family(copies, edits, seed=5):
    """Near copies of one text, most of them too far apart to link, and some linked pairs."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(120)], []
    for k in range(copies):
        w = list(base)
        for i in rng.sample(range(120), edits):
            w[i] = f"e{k}x{i}"
        rows += [(2 * k, " ".join(w))] + [(2 * k + 1, " ".join(w + ["tail"]))] * (k % 3 == 0)
    return rows


def test_near_copies_apart_make_few_pairs(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    monkeypatch.setattr(jaccard_join, "PACKS", 4, raising=False)
    frames = recorded(monkeypatch)
    rows = family(150, 4)
    got = jaccard_join.jaccard_components(docs(*rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 3, 90))
    assert len({r["component_id"] for r in got}) > 100                    # most are not linked
    matrix, units = frames["matrix"][-1][1].select("token", "node"), frames["units"][-1][1].select("node", "unit")
    meets = matrix.join(units, "node").select("token", "unit").distinct().groupBy("token").count().collect()
    assert meets
    pairs = sum(r["count"] * (r["count"] - 1) // 2 for r in meets)
    assert pairs <= 4 * matrix.count()


def test_prefixes_are_shuffled_by_shingle_once(docs, monkeypatch):
    frames = recorded(monkeypatch)
    jaccard_join.jaccard_components(docs(*family(20, 1)), n=5, percent=80).collect()
    plans = [plan for kind in ("shared", "matrix") for plan, _ in frames.get(kind, [])]
    assert plans and max(plan.count("Exchange hashpartitioning(token") for plan in plans) <= 1

"""Language identification in two steps: the family first, then the language within it.

Texts become hashed counts of one to three bytes (square roots, unit length).  Families are
not given: the languages whose mean vectors, less the mean of all, point most the same way are
merged until about as many families are left as a family has languages.  One linear support vector machine per family tells it from the rest; within a
family one machine per pair of languages votes.  Fitting uses a bounded sample, drawn by hash
with an equal share per language; prediction reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protoflow.llm._tables import ensure_shipped, only
from protoflow.llm._tokenize import release
from protoflow.llm._words import LOWER, column_groups, grouped, texts_of

DIM = 2048
ORDERS = (1, 2, 3)
TRAIN_ROWS = 6000      # bound of the sample that the classifier is fitted on, all languages together
UNKNOWN = "und"
LOW, LIMIT = 0.05, 0.5  # a text is recognised with half of the margin that 95 % of its language's labelled texts have
TEXTS = 1024           # texts whose vectors are held at once
_LETTER = re.compile(rb"[A-Za-z]")
_SHIFT = np.uint64(64 - 11)


def features(texts: list[bytes], orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """One unit vector per text (zero for an empty one); grams do not cross texts."""
    out = np.zeros((len(texts), DIM), np.float32)
    for a, b in grouped(texts, 1 << 20, 256):
        sizes = np.array([len(t) for t in texts[a:b]])
        data = np.frombuffer(b"".join(t.translate(LOWER) for t in texts[a:b]), np.uint8).astype(np.uint64)
        of = np.repeat(np.arange(b - a), sizes)
        total = np.zeros((b - a) * DIM, np.int64)
        gram = data.copy()
        for n in range(1, max(orders) + 1):
            if n > 1:
                gram = (gram[:-1] << np.uint64(8)) | data[n - 1:]
            if not len(gram):
                break
            if n not in orders:
                continue
            same = of[:len(gram)] == of[n - 1:]
            slot = ((gram + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int64)
            total += np.bincount((of[:len(gram)] * DIM + slot)[same], minlength=len(total))
        out[a:b] = np.sqrt(total.reshape(b - a, DIM))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def machine(x: np.ndarray, positive: np.ndarray, rounds: int = 150, margin: float = 1e-3) -> np.ndarray:
    """Weights (and bias, last) of a linear support vector machine, both sides weighted alike."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64)
    for t in range(1, rounds + 1):
        inside = y * (x @ w) < 1
        step = 1 / (margin * (t + 1 / (margin * 8)))
        w = (1 - step * margin) * w + step * (x[inside].T @ (y * share)[inside])
        if t > rounds // 2:
            mean += w
    return (mean / (rounds - rounds // 2)).astype(np.float32)


def families(means: np.ndarray) -> list[list[int]]:
    """Languages merged, closest groups first, into about as many families as a family has languages."""
    centred = means - means.mean(axis=0)
    groups = [[i] for i in range(len(means))]
    while len(groups) > np.ceil(np.sqrt(len(means))):
        centre = np.array([centred[g].mean(axis=0) for g in groups])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        near = centre @ centre.T - 3 * np.eye(len(groups))
        i, j = np.unravel_index(np.argmax(near), near.shape)
        groups[min(i, j)] += groups.pop(max(i, j))
    return groups


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = TRAIN_ROWS) -> dict:
    """A model of the languages in ``labelled`` (rows with a NULL text or language are left out).

    About ``rows`` rows (never all of a large table) are drawn by a hash of key and content
    (copies under other keys are drawn apart), an equal share for each language; without any row the model knows no language.
    """
    ensure_shipped(labelled.sparkSession)
    src = only(labelled, key=key, text=text, lang=lang).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}     # one row per language
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "families": []}
    quota = max(1, rows // len(langs))
    share = F.create_map(*[F.lit(v) for n in langs for v in (n, min(1.0, quota / counts[n]))])
    draw = F.shiftrightunsigned(F.xxhash64("key", "text"), 11) / F.lit(float(1 << 53))
    sample = src.where(draw <= share[F.col("lang")])

    def run(batches):
        import pyarrow as pa

        release()
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in grouped(texts, 1 << 21, TEXTS):
                x = features(texts[a:b]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 names=["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(run, "lang string, x binary").toArrow()
    names = np.array(got.column("lang").to_pylist())
    x = np.array([np.frombuffer(v.as_buffer(), np.float16) for v in got.column("x")], np.float32).reshape(-1, DIM)
    order = np.lexsort((x @ np.arange(1, DIM + 1, dtype=np.float32), names))     # rows come in any order
    names, x = names[order], x[order]
    langs = [n for n in langs if (names == n).any()]
    y = np.array([langs.index(n) for n in names])
    groups = families(np.array([x[y == i].mean(axis=0) for i in range(len(langs))]))
    model = {"langs": langs, "families": groups,
             "family": [machine(x, np.isin(y, g)) for g in groups] if len(groups) > 1 else [], "pairs": {}}
    for g in groups:
        for i in g:
            for j in g:
                if i < j:
                    mine = (y == i) | (y == j)
                    model["pairs"][i, j] = machine(x[mine], y[mine] == i)
    return model


def classify(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number, score) of unit vectors; the score multiplies how sure each step is."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
    groups = model["families"]
    if len(groups) > 1:
        margin = x @ np.array(model["family"]).T
        family = margin.argmax(axis=1)
        each = sure(margin)
        score = each[np.arange(len(x)), family] / np.maximum(each.sum(axis=1), 1e-9)
    else:
        family, score = np.zeros(len(x), int), np.ones(len(x))
    out = np.zeros(len(x), int)
    for k, g in enumerate(groups):
        mine = np.flatnonzero(family == k)
        if not len(mine):
            continue
        votes = np.zeros((len(mine), len(g)))
        least = np.ones((len(mine), len(g)))
        for a, i in enumerate(g):
            for b, j in enumerate(g):
                if i < j:
                    m = x[mine] @ model["pairs"][i, j]
                    votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
                    votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
                    least[:, a] = np.minimum(least[:, a], sure(m))
                    least[:, b] = np.minimum(least[:, b], sure(-m))
        best = votes.argmax(axis=1)
        out[mine] = np.array(g)[best]
        score[mine] *= least[np.arange(len(mine)), best]
    return out, score


def margins(model: dict, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The least raw margin by which the machines of its language take each vector (0 with one language alone)."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    out = np.full(len(x), np.inf)
    for i in np.unique(lang).tolist():
        mine = lang == i
        sides = [model["family"][k] for k, g in enumerate(model["families"]) if i in g and model["family"]]
        sides += [w if a == i else -w for (a, b), w in model["pairs"].items() if i in (a, b)]
        for w in sides:
            out[mine] = np.minimum(out[mine], x[mine] @ w)
    return np.where(np.isinf(out), 0, out)


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def limits(labelled: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """The least raw margin of a recognised text, by language: ``LIMIT`` times the margin that all but
    ``LOW`` of the language's labelled and rightly told texts have.  All labelled rows are read."""
    if not model["langs"]:
        return {}
    ensure_shipped(labelled.sparkSession)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    src = only(labelled, text=text, lang=lang).where("text is not null and lang is not null")

    def run(batches):
        import pyarrow as pa

        release()
        model = shared.value
        number = {n: i for i, n in enumerate(model["langs"])}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for a, b, part in column_groups(batch.column(0), 1 << 21, TEXTS):
                texts = texts_of(part)
                x = features(texts)
                k, _ = classify(model, x)
                right = np.array([number.get(n) == i and _has_letter(t)
                                  for n, i, t in zip(names[a:b], k.tolist(), texts)], bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, r in zip(names[a:b], right) if r], pa.string()),
                     pa.array(margins(model, x[right], k[right]), pa.float64())], names=["lang", "margin"])

    rows = src.mapInArrow(run, "lang string, margin double").groupBy("lang").agg(
        F.percentile_approx("margin", LOW, 10000).alias("low")).collect()      # one row per language
    return {r["lang"]: LIMIT * max(r["low"], 0.0) for r in rows}


def identify(docs: DataFrame, model: dict, text: str = "text", least: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); only the text is read for them.

    NULL texts, texts without a letter, and all texts under a model without languages are
    ``und`` with score 0, and with ``least`` (see ``limits``) so are texts with a smaller raw margin
    than their language's.  Equal texts get equal results.  Columns named ``lang_pred`` or ``score`` are
    replaced; an empty table gives an empty result.
    """
    from protoflow.llm._tables import without

    ensure_shipped(docs.sparkSession)
    docs = without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)     # DIM weights per family and pair of languages
    at = docs.columns.index(text)
    schema = docs.select("*").schema.add("lang_pred", "string").add("score", "double")
    names = [f.name for f in schema]

    def run(batches):
        import pyarrow as pa

        release()
        model = shared.value
        for batch in batches:
            pred, score = [], []
            for a, b, part in column_groups(batch.column(at), 1 << 21, TEXTS):
                part = texts_of(part)
                letter = [_has_letter(t) for t in part]
                if model["langs"]:
                    x = features(part)
                    k, s = classify(model, x)
                    if least is not None:
                        bound = np.array([least.get(n, 0.0) for n in model["langs"]])[k]
                        letter = (np.array(letter, bool) & (margins(model, x, k) >= bound)).tolist()
                else:
                    k, s, letter = np.zeros(b - a, int), np.zeros(b - a), [False] * (b - a)
                pred += [model["langs"][i] if y else UNKNOWN for i, y in zip(k.tolist(), letter)]
                score += [v if y else 0.0 for v, y in zip(s.tolist(), letter)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=names)

    return docs.mapInArrow(run, schema)

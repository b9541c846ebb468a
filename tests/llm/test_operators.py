"""Each operator against a brute-force version, and on odd inputs."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from protoflow._session import new_scratch
from protoflow.llm import (binary_ids, components, decontamination, jaccard_join, language_id, line_dedup, lm_scoring,
                           packing, quality_rules, sharding, token_counts)

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in texts]


def key(x):
    return (x is None, x or 0)


# token counts

def test_token_counts(docs, odd_rows):
    df = docs(*odd_rows)
    lengths = [len(x) for x in ids_of(BYTE, [r[1] for r in odd_rows], 0)]
    sums = token_counts.token_counts(df, BYTE, end=0)
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == dict(Counter(lengths))
    for n, r in got.items():
        assert r["docs_over"] == sum(x > n for x in lengths)
        assert r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["tokens_truncated"] == sum(min(x, n) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 1, 3, 5, 100, 10**7):
        assert token_counts.truncated_total(sums, limit).collect()[0]["tokens"] == sum(min(x, limit) for x in lengths)
    q = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect()}
    assert q[1.0] == max(lengths) and q[0.5] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.token_counts(df.limit(0), BYTE).count() == 0


# packing

def test_packing(docs, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(["word"] * (i * 13 % 700))) for i in range(60)]
    out = packing.pack(docs(*rows), WORD, end=1, cell_bytes=100_000).collect()
    want = Counter()
    for r, ids in zip(rows, ids_of(WORD, [r[1] for r in rows], 1)):
        for p in range(0, len(ids), 4096):
            want[(r[0], p // 4096, p, len(ids[p:p + 4096]), ids[p:p + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs(*rows).limit(0), WORD, end=1).count() == 0


# binary ids

def test_binary_ids(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(binary_ids, "SEGMENT", 5000)
    path = new_scratch(spark, "test-ids")
    binary_ids.write_ids(docs(*odd_rows), path, BYTE, end=0)
    got = sorted(binary_ids.read_ids(spark, path, ids=True).collect(), key=lambda r: r["start"])
    assert [key(r["doc_id"])[1] for r in got] == sorted(key(r[0])[1] for r in odd_rows)
    want = Counter((r[0], x.tobytes()) for r, x in zip(odd_rows, ids_of(BYTE, [r[1] for r in odd_rows], 0)))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_binary_ids_of_nothing(spark, docs):
    path = new_scratch(spark, "test-ids")
    binary_ids.write_ids(docs((1, "a")).limit(0), path, BYTE, end=0)
    assert binary_ids.read_ids(spark, path).count() == 0


# sharding

def test_sharding(docs, odd_rows):
    rows = odd_rows + [(i, f"t{i}") for i in range(20, 400)]
    df = docs(*rows)
    out = sharding.shard(df, shards=16, cell_rows=5).collect()
    assert len(out) == len(rows)
    by, placed = defaultdict(list), defaultdict(set)
    for r in out:
        by[r["shard"]].append(r["slot"])
        placed[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    assert all(len(x) == 1 for x in placed.values())
    assert 0 < sum(r["grown_shard"] == 16 for r in out) < len(out) / 6
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(df.limit(300), shards=17).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in out if r["doc_id"] in again)
    assert sharding.shard(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_hash(F.lit(1), 0)


# Jaccard join

def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return Counter((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def near_copies(seed, families=12, copies=14):
    rng = random.Random(seed)
    rows, k = [], 0
    passage = [f"p{i}" for i in range(60)]
    for f in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([2, 8, 60, 150, 400]))]
        if f % 3 == 0:
            base = base + passage
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("n,percent,group", [(3, 90, 32), (3, 90, 2), (5, 80, 3)])
def test_jaccard_components(docs, odd_rows, monkeypatch, n, percent, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rows = [(r[0], r[1]) for r in odd_rows] + [(k + 50, t) for k, t in near_copies(group)]
    got = jaccard_join.jaccard_components(docs(*rows), n=n, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, n, percent)


def test_keep_one(docs):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (9, None), (7, ""), (2, "x y z u v w")]
    kept = jaccard_join.keep_one(docs(*rows), n=5, percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7, 9, 9]
    assert kept.columns == docs(*rows).columns
    assert jaccard_join.keep_one(docs(*rows).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# decontamination

def test_leaks(spark, docs):
    rng = random.Random(4)
    items = [(i, " ".join(f"Q{rng.randint(0, 9999)}" for _ in range(n))) for i, n in enumerate([3, 5, 12, 40, 40, 90])]
    items += [(None, "z1 z2 z3 z4 z5 z6"), (9, None), (10, "")]
    rows = []
    for i, (_, t) in enumerate(items):
        w = (t or "").lower().split()
        noise = lambda n: [f"n{rng.randint(0, 99999)}" for _ in range(n)]
        rows.append((100 + i, " ".join(noise(300) + w + noise(4000))))
        if len(w) > 20:
            rows.append((200 + i, " ".join(noise(30) + w[:len(w) // 2] + noise(30))))           # half of it
            rows.append((300 + i, "\n".join(noise(30) + w[:3] + ["edit"] + w[3:] + noise(3))))  # with an edit
    rows += [(400, None), (401, ""), (102, rows[2][1]), (102, rows[2][1])]
    n = 5
    grams = lambda t: {tuple(w[i:i + n]) for w in [(t or "").lower().split()] for i in range(len(w) - n + 1)}
    want = {(d, i, len(grams(q)), len(grams(q) & grams(t))) for d, t in rows for i, q in items
            if grams(q) and 10 * len(grams(q) & grams(t)) >= 8 * len(grams(q))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(*rows)
    got = decontamination.leaks(df, bench).collect()
    assert sorted((r["doc_id"], key(r["item_id"]), r["n_item"], r["n_shared"]) for r in got) == \
        sorted((d, key(i), a, b) for d, i, a, b in want)
    clean = decontamination.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in rows if d not in {x[0] for x in want})
    assert clean.columns == df.columns
    assert decontamination.leaks(df, bench.limit(0)).count() == decontamination.leaks(df.limit(0), bench).count() == 0


# line dedup

def test_line_dedup(docs, odd_rows):
    rows = list(odd_rows)
    for i in range(30):
        lines = [f"own line {i}", "on every site", "" if i % 2 else "  ", "on two sites" if i < 2 else f"other {i}",
                 "site zero only" if i % 10 == 0 else "x", f"tail {i}"]
        rows.append((100 + i, "\n".join(lines), "en", f"s{i % 10}"))
    rows.append((90, "no line like it\non every site", "en", None))
    got = line_dedup.line_dedup(docs(*rows)).collect()
    sites, first = defaultdict(set), {}
    for r in rows:
        for line in (r[1] or "").split("\n") if r[1] is not None else []:
            if line.strip(" \t\r\x0b\x0c"):
                sites[line].add(r[3] if len(r) > 3 else "s")
                if r[0] is not None:
                    first[line] = min(first.get(line, r[0]), r[0])
    want = Counter()
    for r in rows:
        if r[1] is None:
            want[(r[0], 0, 0, None)] += 1
            continue
        lines = r[1].split("\n")
        kept = [x for x in lines if len(sites.get(x, ())) < 3 or first.get(x) == r[0]]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got) == want
    assert sum(r["n_removed"] for r in got) >= 30
    assert line_dedup.line_dedup(docs(*rows).limit(0)).count() == 0


# language ID

def test_language_id(docs, spark, odd_rows):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.fit(data.where(~held))
    out = language_id.identify(data.where(held), model)
    right = out.where("length(text) > 60").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0]
    assert right > 0.99
    assert sorted(len(g) for g in model["families"]) == [2, 2]
    got = {r["text"]: r for r in language_id.identify(docs(*odd_rows), model).collect()}
    for text in (None, "", "  \n\t ", "... 123 !!!"):
        assert (got[text]["lang_pred"], got[text]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in [*model["langs"], "und"] for r in got.values())
    empty = language_id.fit(docs(*odd_rows).limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs(*odd_rows), empty).collect()} == {"und"}
    one = language_id.fit(docs((1, "abc", "en"), (2, "def", "en")))
    assert language_id.identify(docs((3, "abc")), one).collect()[0]["lang_pred"] == "en"
    assert language_id.identify(docs(*odd_rows).limit(0), model).count() == 0


# quality rules

def test_quality(docs, odd_rows):
    good = " ".join(f"word{i}" for i in range(40))
    bad = " ".join("#$% &&" for _ in range(40))
    rows = list(odd_rows)
    rows += [(1000 + i, f"{good} {i}", "en", "good.org") for i in range(60)]
    rows += [(2000 + i, bad if i % 10 else f"{good} {i}", "en", "spam.org") for i in range(60)]
    rows += [(3000, bad, "en", "small.org"), (3001, good, "en", "small.org")]
    got = {r["doc_id"]: r for r in quality_rules.quality(docs(*rows)).collect()}
    assert all(got[1000 + i]["kept"] for i in range(60))
    assert not any(got[2000 + i]["kept"] for i in range(60))          # the whole host goes
    assert got[2000]["host_rejected"] and not got[2000]["fails_symbols"]
    assert got[3001]["kept"] and not got[3000]["kept"]                # two pages say little about a host
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert quality_rules.quality(docs(*rows)).count() == len(rows)
    assert quality_rules.quality(docs(*rows).limit(0)).count() == 0


# LM scoring

def test_lm_scoring(spark, docs, odd_rows):
    rng = random.Random(9)
    words = ["the", "of", "and", "sea", "ship", "wind", "harbour", "sail"]
    rows = odd_rows + [(100 + i, " ".join(rng.choices(words, weights=range(8, 0, -1), k=40)).title()) for i in range(120)]
    rows += [(300, "the unseenword of")]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    got = lm_scoring.score(docs(*rows), held, chunk_bytes=100_000).collect()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    split = lambda t: [*(t or "").encode().translate(lower).split(), b"\n"]
    count = Counter(w for r in rows if not is_held(r[0]) for w in split(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(r[1]))
        want[(r[0], is_held(r[0]), len(split(r[1])), sum(count[w] > 0 for w in split(r[1])), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
                   for r in got) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) and r["bits_per_byte"] > 0 for r in got)
    assert lm_scoring.score(docs(*rows).limit(0), held).count() == 0
    none = lm_scoring.score(docs((1, "a b")), F.lit(True)).collect()[0]
    assert none["n_known"] == 0 and none["train_tokens"] == 0 and none["base_score"] == 0 and none["score"] < 0


def test_lm_beats_single_tokens_on_held_out_texts(spark):
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    got = lm_scoring.score(data, held).where("held_out").agg(F.sum("score"), F.sum("base_score")).collect()[0]
    assert got[0] > got[1]

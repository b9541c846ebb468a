"""Nothing is sampled, capped or left out where the whole table is asked for."""
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protoflow.llm import lm_scoring, packing
from protoflow.llm._tokenize import Encoder


def test_lm_model_has_its_full_size():
    assert dict(lm_scoring.ORDERS) == {1: 16, 2: 18, 3: 20, 4: 21, 0: 22}
    assert (lm_scoring.CLASSES, lm_scoring.CLASS_GRAMS) == (8, (1, 2, 3))


def test_lm_weights_are_fitted_on_all_words_by_count(spark):
    words = [(f"{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{i * i % 997}".encode(), 1 + i * 7919 % 50) for i in range(3000)]
    words = sorted(dict(words).items())
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in words], "token binary, c long")
    one, many = lm_scoring.train(counts.coalesce(1)), lm_scoring.train(counts.repartition(5))
    assert np.allclose(one["weights"], many["weights"], atol=1e-3)        # not one learner's order
    bits = lm_scoring.Bits([w for w, _ in words], *one["code"])
    times = np.array([c for _, c in words], float)[bits.word]
    table = np.zeros((2, lm_scoring.OFFSETS[-1]))
    for slots in bits.slots:
        np.add.at(table, (bits.y, slots), times)
    n = np.stack([table[0][bits.slots] - (bits.y == 0), table[1][bits.slots] - (bits.y == 1)])
    x, gate = lm_scoring._inputs(np.maximum(n, 0)[0], np.maximum(n, 0)[1])

    def loss(w):
        dot = np.clip((w[gate].T * x).sum(axis=0), -15, 15)
        return (np.log1p(np.exp(np.where(bits.y == 1, -dot, dot))) * times).sum()

    w, rng = one["weights"].astype(float), np.random.default_rng(1)
    for _ in range(20):                                                   # the best for the whole sum
        assert loss(w) <= loss(w + rng.normal(0, 0.05, w.shape)) * (1 + 1e-6)


def test_lm_classes_are_settled_on_all_texts(spark):
    from protoflow.llm.language_id import features

    words = [["sea", "ship", "wind", "sail"], ["zzz", "qqq", "xkx", "vjv"]]
    texts = [" ".join(words[i % 10 == 0][(i + j * j) % 4] for j in range(5 + i % 9)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    centre = lm_scoring.classes(docs, len(texts), n=2, rows=40).astype(float)
    x = features([t.encode() for t in texts], lm_scoring.CLASS_GRAMS)
    near = (x @ centre.T).argmax(axis=1)
    for i in range(len(centre)):                                          # the mean of all texts nearest to it
        mean = x[near == i].mean(axis=0)
        assert np.allclose(centre[i], mean / np.linalg.norm(mean), atol=1e-4)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys_own_with_added_tokens_in_the_text(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)                                 # as it comes, no flag set
    added = ["<|endoftext|>", "<|startoftext|>"]
    texts = ["a plain text of words", "", "a <|endoftext|> b", "a<|endoftext|>b", *added, f"{added[0]}{added[1]}",
             "x\n<|startoftext|>\n y  <|endoftext|> ", "<|endof text|>", "<|ENDOFTEXT|> and a <|endoftext", "■ <|endoftext|>"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    model = Encoder(path)
    assert model.encode(texts) == want
    assert model.encode(texts[::-1]) == want[::-1]                        # and from the word store


def test_packing_keeps_an_added_token(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "a <|endoftext|> b"
    got = packing.pack(docs((1, text)), path, end=1).collect()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [want]


def test_language_stage_rejects_foreign_and_junk_texts(spark):
    import corpus_pipeline as C

    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bad = ["wczoraj wieczorem poszliśmy na długi spacer po lesie i widzieliśmy bardzo dużo różnych ptaków oraz zwierząt",
           "eilen illalla menimme pitkälle kävelylle metsään ja näimme monta erilaista lintua ja eläintä joen rannalla",
           "вчера вечером мы пошли на долгую прогулку в лес и увидели много разных птиц и зверей у реки",
           "x 12345 !!! 99 ## 00", "qzx kjq wvx zzqk xxjv qqw zkx jjv xqz wkq vvx", "for(i=0;i<n;++i){a[i]=b[i]^0xff;}//}}"]
    good = ["the ship sailed on the sea and the wind was high in the night"]
    docs = base.unionByName(spark.createDataFrame(
        [(10**6 + i, t, None, "z", len(t)) for i, t in enumerate(bad + good)], base.schema))
    kept = {r["doc_id"] for r in C.language_id(spark, docs, "").select("doc_id").collect()}
    assert {i for i in kept if i >= 10**6} == {10**6 + len(bad)}
    clean = base.where("length(text) > 60").select("doc_id").collect()
    assert sum(r["doc_id"] in kept for r in clean) >= 0.99 * len(clean)


def test_lm_score_depends_on_the_order_of_words(docs):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    line = ["the", "ship", "left", "a", "harbour", "in", "wind", "and", "rain"]
    rows = [(i, " ".join(line[(i + j) % 9] for j in range(30))) for i in range(60)]
    words = rows[0][1].split()
    rng.shuffle(words)
    rows += [(100, rows[4][1]), (101, " ".join(words))]
    for chunk in (16 << 20, 500):
        got = {r["doc_id"]: r for r in lm_scoring.score(docs(*rows), F.col("doc_id") >= 100, chunk_bytes=chunk).collect()}
        assert got[100]["score"] > got[101]["score"] + 5
        assert abs(got[100]["base_score"] - got[101]["base_score"]) < 1
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got.values())


def test_lm_chunks_of_a_partition_count_its_texts_together(spark, docs):
    """Bits that words share are summed once, and what a text scores does not depend on its chunk."""
    import random

    from pyspark.sql import functions as F

    words = sorted({f"{a}{b}{c}".encode() for a in ("sea", "seal", "s", "") for b in ("", "ward", "wind") for c in ("", "s")} - {b""})
    times = np.arange(1, len(words) + 1).astype(float)
    code = lm_scoring.huffman(np.arange(256))
    whole = lm_scoring.Bits(words, *code)
    once = lm_scoring.Bits(words, *code, times)
    assert len(once.y) < len(whole.y)
    for o in range(len(lm_scoring.ORDERS)):
        sums = [np.bincount(b.slots[o] * 2 + b.y, n, 2 * lm_scoring.OFFSETS[-1]) for b, n in
                ((whole, times[whole.word]), (once, once.times[once.place]))]
        assert (sums[0] == sums[1]).all()

    numbers = np.array([0, 1, 255, 256, 2 ** 63 - 1], np.int64)
    assert all((lm_scoring._unpacked(lm_scoring._packed(numbers[:i])) == numbers[:i]).all() for i in range(1, 6))

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "ship", "left", "a", "harbour", "in", "wind"], k=rng.randint(0, 12)))) for i in range(80)]
    rows += [(i, None) for i in (90, 91, None)] + rows[:9]
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    found = []
    for parts, chunk in ((1, 16 << 20), (3, 300), (7, 1)):
        got = lm_scoring.score(docs(*rows).repartition(parts), held, chunk_bytes=chunk).collect()
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_lm_shuffles_are_removed_when_their_query_has_ended(spark):
    from protoflow.llm._tables import shuffles_freed

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_lm_asks_for_pairs_and_triples_only(spark):
    """A context is counted as the word or the pair that it is: it is not sent a second time."""
    from protoflow.llm.language_id import DIM

    texts = [(i, f"one two three w{i % 3}", i % 4 == 1) for i in range(12)]
    src = spark.createDataFrame(texts, "key long, text string, held_out boolean").coalesce(1)
    centres = np.zeros((1, DIM), np.float32)
    vocab = lm_scoring.vocabulary(src, centres)
    got = [lm_scoring.follows(vocab, 1, which).collect() for which in (0, 1)]
    assert [{r["kind"] for r in g} for g in got] == [{0}, {1}]
    counts = [sorted(lm_scoring._unpacked(bytes(g[0]["counts"])).tolist()) for g in got]
    first = [sum(not h and i % 3 == j for i, _, h in texts) for j in range(3)]
    assert counts[0] == sorted([9, 9, 9, *first, *first]) and counts[1] == counts[0]

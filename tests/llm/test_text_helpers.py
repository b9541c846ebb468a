"""Helpers that run inside tasks: ids by word, Simple-8b, packing, word hashes, sets."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protoflow.llm import binary_ids, jaccard_join, lm_scoring, packing, quality_rules
from protoflow.llm._tokenize import Encoder
from protoflow.llm._words import SLICE, word_hashes

PIECES = [" ", "\n", "\t", "a", "B", "'s", ".", ",", "é", "ß", "1", "■", "\xa0", "　", "the", "\r\n", "  ",
          "<|endoftext|>", "İ", "Σ", "|"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_by_word_equal_ids_by_text(name):
    rng = random.Random(3)
    texts = ["", " ", "\n"] + ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(3000)]
    model = Encoder(public_tokenizers.path(name))
    assert model.units is not None
    got = [ids for i in range(0, len(texts), 700) for ids in model.encode(texts[i:i + 700])]
    assert got == model._whole(texts)


def test_full_word_store_changes_nothing(monkeypatch):
    monkeypatch.setattr("protoflow.llm._tokenize.CACHE_WORDS", 3)
    model = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two three four", "five six one", "two seven", "eight nine ten one two"]
    assert model.encode(texts) + model.encode(texts) == model._whole(texts) * 2
    assert len(model.known) <= 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50000) | st.just(0), max_size=3000), st.sampled_from([7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, blocks = binary_ids.encode(ids, block)
    assert len(blocks) == -(-len(ids) // block)
    assert (binary_ids.decode(words, blocks, len(ids), block) == ids).all()


def test_simple8b_block_stands_alone():
    ids = np.arange(5000, dtype=np.uint64) * 11 % 50000
    words, blocks = binary_ids.encode(ids, 1024)
    part = binary_ids.decode(words[blocks[2]:blocks[3]], np.zeros(1, np.uint32), 1024, 1024)
    assert (part == ids[2048:3072]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=300))
def test_packing_is_gapless_and_near_the_bound(lengths):
    lengths = np.array(lengths, np.int64)
    seq, offset = packing.pack_lengths(lengths)
    for s in set(seq.tolist()):
        mine = np.flatnonzero(seq == s)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()
        assert lengths[mine].sum() <= 4096
    if len(lengths):
        assert seq.max() + 1 <= 1.6 * lengths.sum() / 4096 + 2


def test_configuration_fills_exactly_where_it_can():
    assert packing.configuration([3000, 2000, 1096, 600], [1, 2, 1, 5], 4096) == [1, 0, 1, 0]
    assert packing.configuration([2500, 900, 700], [1, 1, 2], 4096) == [1, 0, 2]


def test_word_hashes_do_not_depend_on_slices():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in range(5000)] + ["x" * (SLICE + 5)]
    text = " ".join(words * 70).encode()
    assert len(text) > 2 * SLICE
    whole, start = word_hashes(text)
    assert len(whole) == len(words) * 70
    once = {w: word_hashes(w.encode())[0][0] for w in words}
    assert [once[w] for w in words * 70] == whole.tolist()
    assert text[start[3]:].split()[0].decode() == words[3]


def test_word_hashes_of_nothing():
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n\t ")[0]) == 0


def brute_counts(text: bytes) -> list[int]:
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    seen = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(seen) if seen.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    return [len(words), len(b"".join(words).decode()), sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
            len(lines) - len(set(lines)), len(covered), len(lines)]


def test_counts_equal_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choices(["a ", "b ", "é", "\n", "#", " ", "x y z u v ", "\t|", "\r"], k=rng.randint(0, 60))).encode()
             for _ in range(400)]
    assert quality_rules.counts_of(texts).tolist() == [brute_counts(t) for t in texts]


def test_sets_of_short_texts():
    w, of = jaccard_join.shingle_sets([b"", b"a", b"a b", b"a b c", b"a b c a b c", b"  ", b"a"])
    assert np.bincount(of, minlength=7).tolist() == [0, 1, 1, 1, 3, 0, 1]
    assert w[of == 1].tolist() == w[of == 6].tolist() and w[of == 1][0] != w[of == 2][0]
    assert w[of == 3][0] in w[of == 4]


def test_open_pair_equals_brute_force():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 200, dtype=np.uint64))
    sets = []
    for _ in range(40):
        keep = rng.random(len(base)) > rng.choice([0.01, 0.05, 0.2])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 60, rng.integers(0, 8), dtype=np.uint64)])))
    i, j = jaccard_join.open_pair(sets[:20], sets[20:], 90)
    want = {(a, b) for a in range(20) for b in range(20)
            if 100 * len(np.intersect1d(sets[a], sets[20 + b])) >= 90 * len(np.union1d(sets[a], sets[20 + b]))}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_huffman_code_is_a_prefix_code():
    length, code = lm_scoring.huffman(np.arange(256) ** 3)
    assert sum(2.0 ** -length) == pytest.approx(1.0)
    strings = [format(c, f"0{n}b") for n, c in zip(length, code)]
    assert all(not b.startswith(a) for a, b in zip(sorted(strings), sorted(strings)[1:]))


def test_spelled_probabilities_sum_to_one():
    """All words of one symbol, their continuations included: bits of the first character sum to one."""
    length, code = lm_scoring.huffman(np.bincount(np.frombuffer(b"abab the cat ", np.uint8), minlength=256))
    rng = np.random.default_rng(0)
    inputs = rng.normal(size=lm_scoring.OFFSETS[-1]).astype(np.float32)
    w = rng.normal(size=(lm_scoring.GATES, lm_scoring.INPUTS)).astype(np.float32)
    first = np.zeros(256)
    for b in range(256):
        bits = lm_scoring.Bits([bytes([b])], length, code)
        n = int(length[b])                                # bits of the first character only
        x = inputs[bits.slots[:, :n]]
        gate = (x != 0).sum(axis=0)
        dot = np.clip(w[:, -1][gate] * 0.3 + (w[gate, :-1].T * x).sum(axis=0), -15, 15)
        first[b] = np.prod(1 / (1 + np.exp(np.where(bits.y[:n] == 1, -dot, dot))))
    assert first.sum() == pytest.approx(1.0, abs=1e-3)


def test_crc_is_of_little_endian_ids():
    ids = np.array([1, 256, 70000], "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"\x01\0\0\0\0\x01\0\0\x70\x11\x01\0")

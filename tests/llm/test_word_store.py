"""The tokenizer's word store: bounded, forgotten on request, and never a change of ids."""
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from protoflow.llm import _tokenize, language_id
from protoflow.llm._words import grouped

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_marks_after_every_letter(name):
    path = public_tokenizers.path(name)
    model = _tokenize.Encoder(path)
    assert set(model.tails) == set(_tokenize.TAILS)
    texts = [f"x {c}{m} y{c}{m}" for c in sorted(_tokenize._BEFORE) for m in _tokenize.TAILS]
    texts += [f"x é{c}. a1{c}. it's. don't, ab.c. ..  n't.\n{c}!\nok" for c in "aZ9é̇İßΣяǅ漢ʰ"]
    assert model.encode(texts) == plain(path, texts) == model.encode(texts)


@pytest.mark.parametrize("name", NAMES)
def test_store_is_bounded_in_bytes(name, monkeypatch):
    monkeypatch.setattr(_tokenize, "CACHE_BYTES", 5000)
    path = public_tokenizers.path(name)
    model = _tokenize.Encoder(path)
    texts = [" ".join(f"w{i}x{j}." for j in range(20)) for i in range(30)] + [""]
    assert model.encode(texts) == plain(path, texts) == model.encode(texts)
    assert 0 < model.held < 5000 + 500 and len(model.known) < 60


def test_release_forgets_the_words():
    path = public_tokenizers.path(NAMES[0])
    model = _tokenize.encoder(path)
    texts = ["one two three", "four. five"]
    before = model.encode(texts)
    assert model.known
    _tokenize.release()
    assert not model.known and model.held == 0 and _tokenize.encoder(path) is model and model.encode(texts) == before


def test_vectors_of_many_tiny_texts():
    texts = [b"ab", b"", b"xyz", "é".encode()] * 700
    whole = language_id.features(texts)
    assert whole.shape == (2800, language_id.DIM) and (whole[:4] == language_id.features(texts[:4])).all()
    assert (whole.reshape(700, 4, -1) == whole[:4]).all()
    assert [b - a for a, b in grouped(texts, 1 << 20, 1000)] == [1000, 1000, 800]


@pytest.mark.parametrize("name", NAMES)
def test_words_are_looked_up_without_boxing(name, monkeypatch):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    model = _tokenize.Encoder(path)
    boxed, units = [], model.units

    class Words:                                           # an Arrow list of words that counts what is boxed
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, item):
            if item == "to_pylist":
                boxed.append(item)
            value = getattr(self.inner, item)
            if item == "dictionary":
                return Words(value)
            if callable(value) and item in ("flatten", "dictionary_encode"):
                return lambda: Words(value())
            return value

        def __array__(self, *args, **kwargs):
            return np.asarray(self.inner)

    def counted(texts):
        found, heads = units(texts)
        return Words(found), heads

    counted_is_spaced = units == model._spaced
    monkeypatch.setattr(model, "units", counted)
    if counted_is_spaced:
        monkeypatch.setattr(model, "_spaced", counted)
    texts = ["one two one. two, three", "", " ", "four  one\nété", "x" * 50, "three\n\n three"]
    assert model.encode(texts) == plain(path, texts) == model.encode(texts)
    assert model.encode(["", ""]) == [b"", b""] and model.encode([]) == []
    assert not boxed and isinstance(pa.array(["a"]).to_numpy(zero_copy_only=False).tolist()[0], str)

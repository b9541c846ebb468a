"""Token ids with the tokenizers library, each distinct word encoded once per worker.

A word's ids do not depend on its neighbours where the tokenizer's own pre-tokenizer cuts
the text, so ids are kept by word and a text is put together from them.  Only cuts that the
pre-tokenizer is sure to make are used; files of another kind are encoded text by text.
Many new words are encoded in one call and cut where a token is known to begin or end a word;
a word with a closing punctuation mark is put together from the word and the mark.  Texts are cut
and their words numbered by Arrow, a group of texts at a time, so Python sees each distinct word of a group once.
"""

from __future__ import annotations

import json
import re

import numpy as np

CACHE_WORDS = 1_000_000
CACHE_BYTES = 112 << 20      # about what a worker's store of words takes at most; results do not depend on it
ENTRY_BYTES = 170            # of a word beside its text and ids
BATCH = 4000
GROUP_BYTES = 1 << 21        # of texts encoded together
TAILS = ".,;:!?"
# letters and digits, also in lower case, of scripts all versions of Unicode agree on: a mark after one stands alone
_BEFORE = frozenset(c for c in map(chr, range(0x530)) if c.isascii() and c.isdigit() or c.isalpha() and c.lower().isalpha())
_MARK = "■"             # a character the word-level vocabulary has as one token
_INNER = re.compile(r"(?<=\S)(?= \S)")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]
_LOADED: dict = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder of one tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def release() -> None:
    """Forget the worker's words: called where a reused worker turns to other work, so that they do not add to its memory."""
    for e in _LOADED.values():
        e.known, e.held = {}, 0


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The library finds these strings in the text before it cuts words: such texts are encoded whole.
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.loose = (any(t.get("normalized") for t in spec.get("added_tokens") or []) and bool(spec.get("normalizer"))
                      or any(c.isspace() or c == _MARK for a in self.added for c in a))
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        self.known: dict = {}
        self.held = 0                                    # bytes of ``known``, about
        self.edge = None                                 # of each id: it begins (or ends) a word
        if self.loose:                                   # their strings cannot be told from the text alone
            self.units = None
        elif (pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
                and not spec.get("normalizer")):
            self.mark = self._single("\n")
            self.units = self._byte_level if self.mark is not None else None
            self._edges(lambda t: t.startswith("\u0120"))       # how such files spell a space
        elif steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s" in str(
                (steps[0].get("pattern") or {}).get("Regex")):
            self.mark = self._single(_MARK)
            self.units = self._spaced if self.mark is not None else None
            suffix = spec["model"].get("end_of_word_suffix")
            if suffix and r"[\p{L}]+" in str((steps[0].get("pattern") or {}).get("Regex")):
                self._edges(lambda t: t.endswith(suffix))
        else:
            self.units = None
        # closing marks that the pre-tokenizer cuts off a word
        self.tails: dict = {}
        if self.units is not None:
            alone, both, word = (self._whole(x) for x in (list(TAILS), ["ab" + c for c in TAILS], ["ab"]))
            self.tails = {c: alone[i] for i, c in enumerate(TAILS) if both[i] == word[0] + alone[i]}

    def _single(self, text: str) -> int | None:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else None

    def _edges(self, is_edge) -> None:
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if is_edge(t)]] = True

    def _run(self, text: str, n: int, first: bool) -> list[bytes] | None:
        """Ids of the ``n`` words of ``text``, cut where a token begins (``first``) or ends a word; None if that
        does not give ``n`` words."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != n or n == 0 or (at[0] != 0 if first else at[-1] != len(ids) - 1):
            return None
        data = ids.tobytes()
        begin = (at if first else np.concatenate([[0], at[:-1] + 1])) * 4
        end = (np.concatenate([at[1:], [len(ids)]]) if first else at + 1) * 4
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], sep: str) -> list[bytes]:
        """Ids of words without the mark, many in one call with the mark between them."""
        if not words:
            return []
        text = sep.join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(words) - 1:
            return self._whole(words)
        data = ids.tobytes()
        begin = np.concatenate([[0], cuts + 1]) * 4
        end = np.concatenate([cuts, [len(ids)]]) * 4
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def _spaced(self, texts: list[str]) -> tuple:
        """(words of each text as an Arrow list, ids before them): cuts at ASCII white space."""
        import pyarrow as pa
        import pyarrow.compute as pc

        return pc.ascii_split_whitespace(pa.array(texts, pa.string())), [b""] * len(texts)

    def _learn_spaced(self, words: list[str]) -> list[bytes]:
        plain = [i for i, w in enumerate(words) if _MARK not in w]
        odd = [i for i, w in enumerate(words) if _MARK in w]
        out: list = [b""] * len(words)
        if self.edge is not None:
            letters = [i for i in plain if words[i].isalpha() and words[i].lower().isalpha()]
            found = self._run(" ".join([words[i] for i in letters]), len(letters), False)
            if found is not None:
                for i, ids in zip(letters, found):
                    out[i] = ids
                known = set(letters)
                plain = [i for i in plain if i not in known]
        for i, ids in zip(plain, self._joined([words[i] for i in plain], f" {_MARK} ")):
            out[i] = ids
        for i, ids in zip(odd, self._whole([words[i] for i in odd]) if odd else []):
            out[i] = ids
        return out

    def _byte_level(self, texts: list[str]) -> tuple:
        """(units of each text as an Arrow list, ids before them); cuts are sure before a space or a line's end that
        a word follows."""
        import pyarrow as pa
        import pyarrow.compute as pc

        first, rest, odd = [], [], {}
        for i, t in enumerate(texts):
            if (any(c in t for c in (_ASCII_SPACES if t.isascii() else _SPACES)) or "  " in t or "\n\n" in t or " \n" in t
                    or "\n " in t or t[:1].isspace() or t[-1:].isspace()):
                head, *units = _INNER.split(t)
                odd[i] = [u[1:] for u in units]
                tail = ""
            else:
                head, _, tail = t.replace("\n", " \n").partition(" ")
            first.append(head)
            rest.append(tail)
        units = pc.split_pattern(pa.array(rest, pa.string()), " ")
        if odd:                                            # few; their units were found one by one
            units = pa.array([odd.get(i, u) for i, u in enumerate(units.to_pylist())], pa.list_(pa.string()))
        return units, self._whole(first)

    def _learn_byte_level(self, new: list) -> list[bytes]:
        out: list = [b""] * len(new)
        head = np.array([self.mark], "<u4").tobytes()
        lines, plain, rest = [], [], []
        for i, w in enumerate(new):                       # white space at an edge would run into the mark
            if "\n" not in w and w.strip() == w:
                plain.append(i)
            elif w.rfind("\n") == 0 and len(w) > 1 and w[1:].strip() == w[1:]:
                lines.append(i)
            else:
                rest.append(i)
        single = [i for i in plain if " " not in new[i]] if self.edge is not None else []
        found = self._run("".join([" " + new[i] for i in single]), len(single), True)
        if found is not None:
            for i, ids in zip(single, found):
                out[i] = ids
            known = set(single)
            plain = [i for i in plain if i not in known]
        for i, ids in zip(plain, self._joined([" " + new[i] for i in plain], "\n")):
            out[i] = ids
        for i, ids in zip(lines, self._joined([new[i][1:] for i in lines], "\n")):
            out[i] = head + ids
        odd = [new[i] if new[i][:1] == "\n" else " " + new[i] for i in rest]
        for i, ids in zip(rest, self._whole(odd) if odd else []):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.units is None:
            return self._whole(texts) if texts else []
        odd = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if odd:
            out: list = [b""] * len(texts)
            for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
                out[i] = ids
            left = sorted(set(range(len(texts))) - set(odd))
            for i, ids in zip(left, self._pieced([texts[i] for i in left])):
                out[i] = ids
            return out
        return self._pieced(texts)

    def _pieced(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        import pyarrow as pa

        units, heads = self.units(texts)
        words = units.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()       # far cheaper than to_pylist
        ids = pa.array(self._ids_of(distinct), pa.large_binary()).take(words.indices)
        if not len(ids):
            return heads
        _, ends, data = ids.buffers()
        data = b"" if data is None else data.to_pybytes()
        bounds = np.frombuffer(ends, np.int64)[np.asarray(units.offsets)].tolist()
        return [h + data[a:b] for h, a, b in zip(heads, bounds, bounds[1:])]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; no word (an empty one) has none."""
        learn = self._learn_spaced if self.units == self._spaced else self._learn_byte_level
        known, tails = self.known, self.tails
        ids = list(map(known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        stems, new = [], set()
        for i in missing:
            u = words[i]
            if u[-1:] in tails and u[-2:-1] in _BEFORE:      # the ids of the word without the mark, and the mark's
                stems.append(i)
                new.add(u[:-1])
            elif u:
                new.add(u)
            else:
                ids[i] = b""
        todo = sorted(new.difference(known) if stems else new)
        fresh: dict = {}
        for i in range(0, len(todo), BATCH):
            fresh.update(zip(todo[i:i + BATCH], learn(todo[i:i + BATCH])))
        for i in stems:
            stem = words[i][:-1]
            found = known.get(stem)
            ids[i] = (fresh[stem] if found is None else found) + tails[words[i][-1]]
        for i in missing:
            if ids[i] is None:
                ids[i] = fresh[words[i]]
        size = sum(map(len, todo)) + sum(map(len, fresh.values())) + ENTRY_BYTES * len(todo)
        if self.held + size <= CACHE_BYTES and len(known) + len(todo) <= CACHE_WORDS:
            known.update(fresh)
            self.held += size
            return ids
        for w in todo:
            if self.held >= CACHE_BYTES or len(known) >= CACHE_WORDS:
                break
            known[w] = fresh[w]
            self.held += len(w) + len(fresh[w]) + ENTRY_BYTES
        return ids


def encode_column(path: str, column, end: int | None):
    """Ids of an Arrow string column, a bounded number of bytes at a time; ``end`` is appended to each.

    Only the texts of a group leave Arrow, and what a group took is given back before the next one."""
    from protoflow.llm._words import column_groups, give_back

    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    model = encoder(path)
    for a, b, part in column_groups(column, GROUP_BYTES):
        yield a, b, [ids + tail for ids in model.encode([t or "" for t in part.to_pylist()])]
        give_back()

"""Licence wording in documents, by templates with optional and replaceable regions.

A template is mandatory wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left
out, and ``<<var;name=holder;words=0-20>>`` stands for any run of that many words.  A template is compiled into an automaton over words: a state per place of the
template, a skip over every optional region, and a run of free states for a replaceable one.  All
automata of a scan run side by side as one subset automaton that is built as texts need it, one look-up
a word; a template is accepted where its mandatory wording stands exactly, and the accepted words are
found by running its reversed automaton back from the last one.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protoflow.llm._tables import ensure_shipped, only, without
from protoflow.llm._words import texts_of

# Words are runs of digits, letters and anything beyond ASCII; A-Z are read as a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CHUNK = 1 << 20              # bytes of a text cut into words at once
SUBSETS = 20_000             # states of the subset automaton kept; beyond, it is built anew
_MARKUP = re.compile(r"<<(.*?)>>", re.S)
_VAR = re.compile(r"var(?:;\s*name=[^;>]*)?;\s*words=(\d+)-(\d+)\s*")

# Labels and their phrases.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Notices as their licences word them, with the parts that vary marked.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                   "with the license you may obtain a copy of the license at <<var;name=url;words=0-8>> unless required by "
                   "applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under <<beginOptional>>the terms of<<endOptional>> the mit license"),
    ("mit", "licensed under <<beginOptional>>the terms of<<endOptional>> the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
            "and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all "
            "copies or substantial portions of the software"),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license version 3"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license version 2"),
    ("gpl", "<<beginOptional>>this program<<endOptional>> is free software you can redistribute it and or modify it under the terms "
            "of the gnu <<beginOptional>>lesser<<endOptional>> general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under <<beginOptional>>a creative commons license<<endOptional>> cc by nc <<beginOptional>>4 0<<endOptional>>"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above "
            "copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;words=0-12>> all rights reserved"),
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def pattern(markup: str) -> str:
    """A template as a regular expression over words joined, begun and ended by single spaces."""
    out = []
    for i, piece in enumerate(_MARKUP.split(markup)):
        var = _VAR.fullmatch(piece) if i % 2 else None
        if i % 2 == 0:
            out.append("".join(f" {w.decode()}" for w in words_of(piece.encode())))
        elif var:
            out.append(f"(?: [^ ]+){{{var[1]},{var[2]}}}")
        else:
            out.append("(?:" if piece == "beginOptional" else ")?")
    return "".join(out) + " "


class Template:
    """An automaton over words: ``arcs[state]`` is (word or None for any, next state); None-word arcs are free."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.arcs: list[list] = [[]]
        self.skips: list[set] = [set()]              # states reached without a word
        self.mandatory = 0
        open_at, at = [], 0
        for i, piece in enumerate(_MARKUP.split(markup)):
            var = _VAR.fullmatch(piece) if i % 2 else None
            if i % 2 == 0:
                for w in words_of(piece.encode()):
                    at = self._next(at, w)
                    self.mandatory += not open_at
            elif piece == "beginOptional":
                open_at.append(at)
            elif piece == "endOptional" and open_at:
                self.skips[open_at.pop()].add(at)
            elif var:
                least, most = int(var[1]), int(var[2])
                ways = []
                for n in range(most):
                    if n >= least:
                        ways.append(at)
                    at = self._next(at, None)
                for w in ways:
                    self.skips[w].add(at)
            else:
                raise ValueError(f"unknown markup <<{piece}>> in {label}")
        if open_at:
            raise ValueError(f"an optional region of {label} has no end")
        if not self.mandatory:
            raise ValueError(f"{label} has no mandatory word")
        self.final = at
        self.back: list[list] = [[] for _ in self.arcs]
        for s, arcs in enumerate(self.arcs):
            for w, to in arcs:
                self.back[to].append((w, s))
        self.back_skips = [{s for s, to in enumerate(self.skips) if i in to} for i in range(len(self.arcs))]

    def _next(self, at: int, word) -> int:
        self.arcs.append([])
        self.skips.append(set())
        self.arcs[at].append((word, len(self.arcs) - 1))
        return len(self.arcs) - 1

    @property
    def longest(self) -> int:
        return len(self.arcs) - 1

    @staticmethod
    def closure(states, skips) -> set:
        out, left = set(), list(states)
        while left:
            s = left.pop()
            if s not in out:
                out.add(s)
                left.extend(skips[s])
        return out

    def begin(self, words: list, end: int) -> int:
        """The first word of the longest accepted run that ends before ``end``."""
        states, at, found = self.closure({self.final}, self.back_skips), end, end
        while states and at > 0:
            at -= 1
            states = self.closure({s for t in states for w, s in self.back[t] if w is None or w == words[at]}, self.back_skips)
            if 0 in states:
                found = at
        return found


class Scanner:
    """All templates at once; subsets of their states are numbered as texts reach them."""

    def __init__(self, templates):
        self.templates = list(templates)
        self.vocabulary: dict = {}
        for t in self.templates:
            for arcs in t.arcs:
                for w, _ in arcs:
                    if w is not None:
                        self.vocabulary.setdefault(w, len(self.vocabulary) + 1)      # 0: any other word
        self.longest = max((t.longest for t in self.templates), default=0)
        self.starts = frozenset((n, s) for n, t in enumerate(self.templates) for s in t.closure({0}, t.skips))
        self.arcs = [[[(None if w is None else self.vocabulary[w], to) for w, to in arcs] for arcs in t.arcs]
                     for t in self.templates]
        self._reset()

    def _reset(self) -> None:
        self.number = {self.starts: 0}
        self.subsets, self.table, self.accepts = [self.starts], [{}], [()]

    def _step(self, state: int, word: int) -> int:
        reached: set = set()
        for n, s in self.subsets[state]:
            for w, to in self.arcs[n][s]:
                if w is None or w == word:
                    t = self.templates[n]
                    reached.update((n, x) for x in t.closure({to}, t.skips))
        accepted = tuple(sorted(n for n, s in reached if s == self.templates[n].final))
        subset = frozenset(reached) | self.starts
        # one subset with and without an acceptance cannot be: the final state is in it
        found = self.number.get(subset)
        if found is None:
            found = self.number[subset] = len(self.subsets)
            self.subsets.append(subset)
            self.table.append({})
            self.accepts.append(accepted)
        self.table[state][word] = found
        return found

    def scan(self, text: bytes) -> tuple[int, list]:
        """(number of words, [(template number, first word, word after the last)]) of one text."""
        if len(self.subsets) > SUBSETS:
            self._reset()
        hits, seen, kept, state = [], 0, [], 0
        get = self.vocabulary.get
        for part in _chunks(text):
            words = words_of(part)
            tail = len(kept)
            kept += words
            table, accepts = self.table, self.accepts
            for i, w in enumerate(words, tail):
                word = get(w, 0)
                after = table[state].get(word)
                state = self._step(state, word) if after is None else after
                if accepts[state]:
                    for n in accepts[state]:
                        hits.append((n, seen - tail + self.templates[n].begin(kept, i + 1), seen - tail + i + 1))
            seen += len(words)
            kept = kept[max(len(kept) - self.longest, 0):]
        return seen, hits


def _chunks(text: bytes):
    """Slices of about CHUNK bytes that end between words."""
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end


def _scan(batches, templates, n_phrases: int):
    import pyarrow as pa

    match = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("template", pa.bool_())])
    scanner = Scanner([Template(label, markup) for label, markup in templates])
    for batch in batches:
        words, found = [], []
        for text in texts_of(batch.column(batch.num_columns - 1)):
            n, hits = scanner.scan(text)
            words.append(n)
            found.append([{"label": templates[t][0], "first_word": a, "last_word": b - 1, "template": t >= n_phrases}
                          for t, a, b in hits])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(found, pa.list_(match))],
                                         names=[*batch.schema.names[:-1], "n_words", "matches"])


def license_matches(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``matches``: array of (label, first_word, last_word, template)
    for every place of a phrase and every accepted run of a template (``template`` true), words from 0.

    One pass without a shuffle.  NULL texts are empty; repeated rows and other columns are kept, but a column
    named like an added one is replaced; an empty table gives no rows.
    """
    ensure_shipped(docs.sparkSession)
    rest = without(docs, text, "n_words", "matches", "_pf_text")
    src = docs.select(*[docs[c] for c in rest.columns], docs[text].alias("_pf_text"))
    match = (T.StructType().add("label", "string").add("first_word", "long").add("last_word", "long").add("template", "boolean"))
    schema = T.StructType([*src.schema.fields[:-1]]).add("n_words", "long").add("matches", T.ArrayType(match))
    run = partial(_scan, templates=[*phrases, *templates], n_phrases=len(phrases))
    return src.mapInArrow(run, schema)


def license_labels(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per row of ``docs``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the smallest and largest
    first word of one (NULL without any).  ``score`` is 1 if a template is accepted, 0.5 if only a phrase is
    found, else 0.  Odd rows as in ``license_matches``; a NULL key keeps its row.
    """
    found = license_matches(only(docs, key=key, text=text), "text", phrases, templates)
    base = F.filter("matches", lambda m: ~m["template"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    score = (F.when(F.exists("matches", lambda m: m["template"]), 1.0).when(F.size("matches") > 0, 0.5).otherwise(0.0))
    return found.select(
        F.col("key").alias(key), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        score.alias("score"), "matches")

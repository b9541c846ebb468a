"""Licence scan against regular expressions over plain word lists, and on odd texts."""
import random
import re

import pytest
from pyspark.sql import functions as F

from protoflow.llm import license_scan as L

MIT = dict(L.TEMPLATES)["isc"]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, phrases=L.PHRASES, templates=L.TEMPLATES):
    words = plain_words(text)
    places = [(i, label) for label, phrase in phrases for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    joined = " " + " ".join(words) + " "
    own = {label for label, markup in templates if re.search(L.pattern(markup), joined)}
    base = {label for _, label in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0)


def texts(seed, n=300):
    rng = random.Random(seed)
    parts = [m for _, m in L.TEMPLATES + L.PHRASES]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(1, 4)):
            part = rng.choice(parts)
            part = re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", lambda m: rng.choice(["", m[1]]), part)
            part = re.sub(r"<<var.*?>>", lambda m: " ".join(["w"] * rng.randrange(14)), part)
            words = part.split()
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "other"
            text += [w.upper() if rng.random() < 0.2 else w for w in words] + ["Été"] * rng.randrange(2)
        out.append(rng.choice([" ", "\n", ", ", "/"]).join(text))
    return out


def test_labels_equal_brute_force(docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts(1))]
    rows += [(900, "MIT License MIT license mit LICENSE"), (901, "the MIT-License."), (902, "MITLicense"), (903, "CC BY-NC 4.0 cc\x00by")]
    got = L.license_labels(docs(*rows)).drop("matches").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert L.license_labels(docs(*rows).limit(0)).count() == 0


def test_spans_are_the_accepted_words(docs):
    text = "One two. Copyright (c) 2020 Ann Lee, All Rights Reserved. Licensed under the Apache License, 2.0 apache license"
    matches = L.license_matches(docs((1, text))).select("doc_id", "n_words", F.explode("matches").alias("m")).collect()
    words = plain_words(text)
    found = {(r["m"]["label"], r["m"]["template"], " ".join(words[r["m"]["first_word"]:r["m"]["last_word"] + 1])) for r in matches}
    assert found == {("all-rights-reserved", True, "copyright c 2020 ann lee all rights reserved"),
                     ("apache-2.0", True, "licensed under the apache license 2 0"), ("apache", False, "apache license")}


def test_columns_of_the_table_stay(docs):
    df = docs((1, "x")).withColumn("n_words", F.lit("mine")).withColumn("matches", F.lit(1))
    found = L.license_matches(df)
    assert found.columns.count("n_words") == 1 and "source" in found.columns and found.first()["n_words"] == 1


def test_matches_across_slices(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 7)
    scanner = L.Scanner([L.Template(*t) for t in [*L.PHRASES, *L.TEMPLATES]])
    text = " pad ".join(texts(2, 60))
    n, hits = scanner.scan(text.encode())
    monkeypatch.setattr(L, "CHUNK", 1 << 20)
    assert (n, hits) == scanner.scan(text.encode()) and n == len(plain_words(text)) and len(hits) > 50


def test_subsets_are_rebuilt(monkeypatch):
    monkeypatch.setattr(L, "SUBSETS", 5)
    scanner = L.Scanner([L.Template(*t) for t in L.TEMPLATES])
    fresh = [L.Scanner([L.Template(*t) for t in L.TEMPLATES]).scan(t.encode()) for t in texts(3, 20)]
    assert [scanner.scan(t.encode()) for t in texts(3, 20)] == fresh


def test_nested_regions_and_bad_markup():
    t = L.Template("x", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e <<var;words=1-2>> f")
    scan = L.Scanner([t]).scan
    accepted = [s for s in ("a e x f", "a b d e x f", "a b c d e x y f", "a e f", "a b e x f", "a e x y z f") if scan(s.encode())[1]]
    assert accepted == ["a e x f", "a b d e x f", "a b c d e x y f"] and t.mandatory == 3
    for bad in ("a <<beginOptional>> b", "a <<other>> b", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            L.Template("x", bad)

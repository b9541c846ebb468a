"""Host verdicts against a plain computation, with bad hosts planted among many."""
import math
import random
from collections import defaultdict

from protoflow.llm import quality_rules as Q


def brute(rows):
    """host -> (rates, rejected) from {host: [failures by rule]} by the definition."""
    n = {h: len(v) for h, v in rows.items()}
    total = sum(n.values())
    out = {h: ({}, False) for h in rows}
    for r in Q.RULES:
        k = {h: sum(x[r] for x in v) for h, v in rows.items()}
        m = sum(k.values()) / total
        spread = sum(n[h] * (k[h] / n[h] - m) ** 2 for h in rows)
        room = total - sum(x * x for x in n.values()) / total - (len(n) - 1)
        between = (spread - (len(n) - 1) * m * (1 - m)) / room if room > 0 else 0
        weight = min(max(m * (1 - m) / between - 1, 1e-3), Q.MAX_WEIGHT) if between > 0 and 0 < m < 1 else Q.MAX_WEIGHT
        for h in rows:
            a, b = m * weight + k[h], (1 - m) * weight + n[h] - k[h]
            mean = a / (a + b)
            low = mean - Q.SURE * math.sqrt(mean * (1 - mean) / (a + b + 1))
            out[h][0][r] = mean
            out[h] = (out[h][0], out[h][1] or low > max(Q.MAX_HOST_RATE, m))
    return out


def text(rng, bad):
    """A clean text, or one that fails the symbols rule but not the base rules."""
    words = [f"w{rng.randrange(10**6)}abc" for _ in range(40)]
    return " ".join(w + ("##" if bad else "") for w in words)


def test_planted_hosts_at_corpus_size(spark, docs):
    rng, rows, doc = random.Random(5), [], 0
    for h in range(400):
        size, rate = rng.choice([1, 2, 5, 20, 60]), 0.03
        if h < 4:
            size, rate = 80, 0.6                                   # bad hosts
        elif h < 8:
            size, rate = 80, 0.12                                  # worse than the rest, not bad
        for _ in range(size):
            rows.append((doc, text(rng, rng.random() < rate), "en", f"h{h}" if h != 9 else None))
            doc += 1
    got = Q.quality(docs(*rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["host"]].append({x: r[f"fails_{x}"] for x in Q.RULES})
    want = brute(by)
    rejected = set()
    for r in got:
        rates, bad = want[r["host"]]
        assert r["host_rejected"] == bad and r["kept"] == (not (r["base_failed"] or bad)) and r["host_docs"] == len(by[r["host"]])
        assert all(abs(r[f"rate_{x}"] - rates[x]) < 1e-9 for x in Q.RULES)
        if bad:
            rejected.add(r["host"])
    assert rejected == {"h0", "h1", "h2", "h3"}                    # also their clean pages go; nobody else's do
    assert sum(r["fails_symbols"] and r["kept"] for r in got) > 50  # a failure alone is the host's matter


def test_hosts_alike_share_the_corpus_rate():
    assert Q.prior(0, 0, 0.0, 0, 0.0) == (0.0, Q.MAX_WEIGHT)
    m, weight = Q.prior(10, 1000, 100_000.0, 100, 10.0)            # every host at exactly one in ten
    assert m == 0.1 and weight == Q.MAX_WEIGHT
    m, weight = Q.prior(2, 200, 20_000.0, 100, 100.0)              # one host all bad, one all good
    assert m == 0.5 and weight < 0.1

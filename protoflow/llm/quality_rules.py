"""Quality rules per document, and verdicts on whole hosts.

Counts are taken in one pass over the texts.  Rule failures are summed by host; a host's
failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of
moments, with the binomial noise of the hosts' own rates taken out), so a host with few pages
needs more evidence than a large one.  A host is rejected with all its documents when, for any
rule, its rate two standard deviations below the posterior mean still exceeds both
``max_host_rate`` and the corpus rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protoflow.llm._tables import ensure_shipped, only, written
from protoflow.llm._words import IS_SPACE, group_words, grouped, texts_of, windows

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
MAX_HOST_RATE = 0.3
SURE = 2.0             # standard deviations of the posterior
MAX_WEIGHT = 1e6       # of the prior, in documents: hosts that differ by no more than chance

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_CHAR = ~IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)     # first byte of a character in a word


def _repeated(h: np.ndarray, text: np.ndarray, n_texts: int, n: int) -> np.ndarray:
    """Words of each text that lie in an ``n``-word window the text has twice or more."""
    w, at = windows(h, text, n)
    if not len(w):
        return np.zeros(n_texts, np.int64)
    order = np.lexsort((w, text[at]))
    same = (w[order][1:] == w[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n_texts)


def counts_of(texts: list[bytes], n: int = 5) -> np.ndarray:
    """An array of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for a, b in grouped(texts):
        part = texts[a:b]
        h, text, first = group_words(part)
        out[a:b, 0] = np.diff(first)
        out[a:b, 4] = _repeated(h, text, b - a, n)
        for i, t in enumerate(part):
            data = np.frombuffer(t, np.uint8)
            lines = [x for x in t.split(b"\n") if x.strip(BLANK)]
            out[a + i, 1] = np.count_nonzero(_CHAR[data])
            out[a + i, 2] = np.count_nonzero(_SYMBOL[data])
            out[a + i, 3] = len(lines) - len(set(lines))
            out[a + i, 5] = len(lines)
    return out


def rule_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, COUNTS): one row per row of ``docs``, in one pass without a shuffle."""
    ensure_shipped(docs.sparkSession)
    src = only(docs, key=key, host=host, text=text)
    schema = src.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = counts_of(texts_of(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]],
                names=["key", "host", *COUNTS])

    return src.mapInArrow(run, schema)


def failures(counts: DataFrame) -> DataFrame:
    """``counts`` with one boolean per rule (``fails_<rule>``) and ``base_failed``."""
    n = F.col("n_words")
    fails = {
        "short": n < 10,
        "repeats": F.col("n_repeat_words") * 100 > n * 20,
        "symbols": F.col("n_symbols") * 10 > n,
        "dup_lines": (F.col("n_dup_lines") >= 4) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3),
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20),
    }
    return counts.select("*", *[fails[r].alias(f"fails_{r}") for r in RULES],
                         (fails["short"] | fails["repeats"]).alias("base_failed"))


def host_verdicts(failed: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_docs, rate_<rule> ..., host_rejected): shrunk failure rates of every host.

    ``failed`` has a host and the booleans ``fails_<rule>``; a NULL host is a host; without rows there is none."""
    hosts = failed.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    n = F.col("host_docs")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n.cast("double") * n).alias("nn"),
                     *[F.sum(f"n_{r}").alias(f"k_{r}") for r in RULES],
                     *[F.sum(F.col(f"n_{r}").cast("double") * F.col(f"n_{r}") / n).alias(f"kk_{r}") for r in RULES]).first()
    rates, lows = [], []
    for r in RULES:
        m, weight = prior(sums["hosts"], sums["n"] or 0, sums["nn"] or 0.0, sums[f"k_{r}"] or 0, sums[f"kk_{r}"] or 0.0)
        mean = (F.col(f"n_{r}") + F.lit(m * weight)) / (n + F.lit(weight))
        rates.append(mean.alias(f"rate_{r}"))
        low = mean - F.lit(SURE) * F.sqrt(mean * (1 - mean) / (n + F.lit(weight + 1.0)))
        lows.append(low > F.lit(max(max_rate, m)))
    rejected = lows[0]
    for x in lows[1:]:
        rejected = rejected | x
    return hosts.select("host", "host_docs", *rates, rejected.alias("host_rejected"))


def prior(hosts: int, n: int, nn: float, k: int, kk: float) -> tuple[float, float]:
    """(mean, weight) of the beta prior of failure rates, from sums over the hosts: their number, documents, squared
    documents, failures, and squared failures over documents.

    The spread of the hosts' rates about the corpus rate, less what binomial noise alone would give, is
    the variance between hosts; the weight is the number of documents the prior counts as.
    """
    if not n:
        return 0.0, MAX_WEIGHT
    m = k / n
    spread, effective = kk - n * m * m, n - nn / n - (hosts - 1)
    between = (spread - (hosts - 1) * m * (1 - m)) / effective if effective > 0 else 0.0
    if between <= 0 or not 0 < m < 1:
        return m, MAX_WEIGHT
    return m, min(max(m * (1 - m) / between - 1, 1e-3), MAX_WEIGHT)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
            max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: its key, counts, rules failed, its host's rates, ``kept``.

    A document is kept unless it fails the base rules or its host is rejected; the other rules speak through the host.  NULL and empty texts
    have no words and fail; a NULL host is a host of its own; repeated rows count each time;
    other columns are ignored; an empty table gives an empty result.
    """
    failed = written(failures(rule_counts(docs, key, text, host)), "quality")
    verdicts = host_verdicts(failed, max_host_rate).withColumnRenamed("host", "_pf_host")
    joined = failed.join(verdicts, F.col("host").eqNullSafe(F.col("_pf_host")), "left").drop("_pf_host")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected"))).withColumnRenamed("key", key)

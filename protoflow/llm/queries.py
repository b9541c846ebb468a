"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protoflow._session import new_scratch
from protoflow.llm._tables import table
from protoflow.llm.binary_ids import read_ids, write_ids
from protoflow.llm.conversation_repair import damaged_report
from protoflow.llm.decontamination import leaks
from protoflow.llm.jaccard_join import jaccard_components
from protoflow.llm.language_id import fit, identify
from protoflow.llm.license_scan import PHRASES, TEMPLATES, license_labels, pattern
from protoflow.llm.line_dedup import line_dedup
from protoflow.llm.lm_scoring import score
from protoflow.llm.packing import pack
from protoflow.llm.quality_rules import quality
from protoflow.llm.sharding import shard
from protoflow.llm.token_counts import token_counts
from protoflow.llm.vector_codes import compress


def _remainder(key: str, m: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(m))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums of the length histogram for every distinct length, end id included."""
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), end=50256)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), _remainder("doc_id", 5) == 1)


def op4_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch(spark, "llm-token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return read_ids(spark, path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_pf_k")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _remainder("doc_id", 4) == 2
    model = fit(docs.where(~F.coalesce(held, F.lit(False))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "host", "host_rejected")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_report(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents")).drop("matches")


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_best_fit_packing, op3_lm_scoring, op4_binary_ids, op5_sharding, op6_jaccard_join,
    op7_decontamination, op8_line_dedup, op9_language_id, op10_quality_rules, op11_vector_codes,
    op12_conversation_repair, op13_license_scan)}

_WORDS = "[x FOR x IN string_split_regex(lower(coalesce({}, '')), '[ \\t-\\r]+') IF x <> '']"


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The codes of ``compress``: parts as rows, nearest entry as the least of (distance, entry) in one number."""
    ctes = [f"""
kept AS (SELECT vec_id, label, len(embedding) // {parts} AS width, unnest(embedding) AS x,
                generate_subscripts(embedding, 1) - 1 AS i
         FROM embeddings WHERE embedding IS NOT NULL
           AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
c AS (SELECT vec_id, label, i // width AS part, i % width AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x
      FROM kept),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM c)
         ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT part, entry, pos, x FROM c JOIN seed USING (vec_id))"""]
    for i in range(rounds + 1):
        ctes.append(f"""
n{i} AS (SELECT vec_id, part, min(d) % {entries} AS entry, min(d) // {entries} AS error
         FROM (SELECT vec_id, c.part, entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) * {entries} + entry AS d
               FROM c JOIN b{i} b ON c.part = b.part AND c.pos = b.pos GROUP BY vec_id, c.part, entry)
         GROUP BY vec_id, part)""")
        if i < rounds:
            ctes.append(f"""
m{i} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
         FROM c JOIN n{i} USING (vec_id, part) GROUP BY part, entry, pos),
b{i + 1} AS (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
             FROM b{i} LEFT JOIN m{i} USING (part, entry, pos))""")
    return f"""WITH {",".join(ctes)},
sha AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}),
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error
      FROM n{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM e JOIN (SELECT DISTINCT vec_id, label FROM c) USING (vec_id) CROSS JOIN sha"""


def _license_scan_sql() -> str:
    """Phrases as places of words in a row, templates as regular expressions over the joined words."""
    depth = max(len(p.split()) for p, _ in _phrases())
    places = " UNION ALL ".join(
        f"SELECT id, pos, '{label}' AS label FROM p WHERE "
        + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split())) for phrase, label in _phrases())
    accepted = ", ".join(f"CASE WHEN regexp_matches(t, '{pattern(markup)}') THEN '{label}' END" for label, markup in TEMPLATES)
    ahead = ", ".join(f"lead(w, {i}) OVER (PARTITION BY id ORDER BY pos) AS w{i}" for i in range(1, depth))
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d),
p AS (SELECT id, pos, w AS w0, {ahead} FROM u),
h AS ({places}),
g AS (SELECT id, count(*) AS n, min(pos) AS a, max(pos) AS b, list(DISTINCT label) AS base FROM h GROUP BY id),
m AS (SELECT id, doc_id, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS t FROM d),
x AS (SELECT id, doc_id, n_words, [y FOR y IN [{accepted}] IF y IS NOT NULL] AS own FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM x LEFT JOIN g USING (id)"""


def _phrases():
    return [(markup, label) for label, markup in PHRASES]


ORACLE = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_license_scan": _license_scan_sql(),
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM dg JOIN bg USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * 8""",
    "op8_line_dedup": """
WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
shared AS (SELECT line, min(doc_id) AS first FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
           GROUP BY line HAVING count(DISTINCT site) >= 3),
kept AS (SELECT doc_id, count(*) AS n_lines,
                count(*) FILTER (WHERE first IS NOT NULL AND doc_id <> first) AS n_removed,
                coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR doc_id = first), '') AS text
         FROM l LEFT JOIN shared USING (line) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text AS text
FROM documents LEFT JOIN kept USING (doc_id)""",
}

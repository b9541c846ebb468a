"""A training-data pipeline over the documents: language, shared lines, near copies, benchmark leaks, packing.

Each stage takes the documents its predecessor kept and is written to the shared folder
before the next one reads them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protoflow.llm._tables import table, written
from protoflow.llm.decontamination import decontaminate
from protoflow.llm.jaccard_join import keep_one
from protoflow.llm.language_id import UNKNOWN, fit, identify, limits
from protoflow.llm.line_dedup import line_dedup
from protoflow.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the limits come from the margins of all labelled documents."""
    model = fit(docs)
    found = identify(docs, model, least=limits(docs, model))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; ``n_chars`` follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return keep_one(docs, n=5, percent=80).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES = [
    ("language ID", language_id),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

ORACLE_SQL = None      # the first and last stages have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs

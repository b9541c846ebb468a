"""Shared plumbing of the operators: reading the tables, written intermediate results, clashing names."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protoflow._session import ensure_shipped, new_scratch

__all__ = ["ensure_shipped", "table", "written", "shuffles_freed", "only", "without", "row_key", "ceil_div"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, kind: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read and not a recomputation."""
    path = new_scratch(df.sparkSession, f"llm-{kind}")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, the shuffle files of a query are removed when the query has ended, not at some later garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns under the operator's own names; every other column is left out."""
    return df.select(*[df[c].alias(a) for a, c in columns.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator adds (compared without case), so that an
    input column of the same name is replaced and never ambiguous."""
    drop = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in drop])


def row_key(*columns: Column) -> Column:
    """A stable 64-bit key of a row's content; NULL differs from an empty text."""
    parts = []
    for c in columns:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def ceil_div(n: int, size: int) -> int:
    return max(1, -(-n // size))

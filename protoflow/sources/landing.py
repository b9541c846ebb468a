"""Landing of message files day by day: only what changed, and with counts taken on the way.

The landed table is its own manifest: it holds each file's path, modification time and length, and
reading them skips the content.  A run lists the tree, compares the two by a join on the path, and
rewrites the days that have a new, changed or gone file.  Files of these days that did not change are
taken from the table; only new and changed files are opened.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import _hadoop, gathered, new_scratch
from .files import read_listed, with_path_partition
from .listing import list_tree, spelled

LANDED = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                       T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
                       T.StructField("view_date", T.DateType())])
STATES = ("new", "changed", "gone", "same")
NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def _days_regex(days) -> str:
    """Day patterns (``*``, ``?`` and ``[...]`` inside a part) as a regular expression over the folders."""
    def one(day):
        parts = re.split(r"(\[[^\]]*\]|\*|\?)", day.strip("/"))
        return "".join(p if p.startswith("[") else {"*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)

    return "(?:" + "|".join(map(one, [days] if isinstance(days, str) else days)) + ")/"


def landed_table(spark: SparkSession, path: str) -> DataFrame:
    """The raw table at ``path``; no rows if nothing was landed yet."""
    fs, folder = _hadoop(spark, path)
    if not fs.exists(folder):
        return spark.createDataFrame([], LANDED)
    return spark.read.schema(LANDED).parquet(path)


def file_changes(spark: SparkSession, base: str, path: str, days=None, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, view_date, state of every file that is in the tree or in the landed table.

    ``state`` is ``new``, ``changed`` (another length or time), ``gone`` or ``same``.  With ``days`` only files
    of these day folders are listed and compared.  Written to the shared folder: content is never read.
    """
    listed = with_path_partition(list_tree(spark, base, days=days, glob=glob)).drop("view_hour")
    have = landed_table(spark, path).select(F.col("path").alias("_p"), F.col("modificationTime").alias("_m"),
                                            F.col("length").alias("_l"), F.col("view_date").alias("_d"))
    root = spelled(base.rstrip("/")) + "/"
    have = have.where(F.startswith(F.col("_p"), F.lit(root)))
    if days is not None:
        have = have.where(F.expr(f"substring(_p, {len(root) + 1})").rlike("^" + _days_regex(days)))
    both = listed.join(have, F.col("path") == F.col("_p"), "full")
    state = (F.when(F.col("_p").isNull(), "new").when(F.col("path").isNull(), "gone")
             .when((F.col("length") != F.col("_l")) | (F.col("modificationTime") != F.col("_m")), "changed").otherwise("same"))
    target = new_scratch(spark, "changes")
    both.select(F.coalesce("path", "_p").alias("path"), F.coalesce("modificationTime", "_m").alias("modificationTime"),
                F.coalesce("length", "_l").alias("length"), F.coalesce("view_date", "_d").alias("view_date"),
                state.alias("state")).write.parquet(target)
    return spark.read.parquet(target)


def land_changes(spark: SparkSession, base: str, path: str, days=None, glob: str | None = None) -> DataFrame:
    """Bring the raw table at ``path`` up to date with the tree; view_date, new, changed, gone, same, bytes_read per day.

    Days without a change are not written, nor is any of their files opened.  A day whose last file
    is gone loses its partition.  The table is compared anew at every run, so a run that was cut off is
    made good by the next one.  Two runs on one table must not overlap.
    """
    changes = file_changes(spark, base, path, days, glob)
    per_day = changes.groupBy("view_date").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in STATES],
        F.coalesce(F.sum(F.when(F.col("state").isin("new", "changed"), F.col("length"))), F.lit(0)).alias("bytes_read"))
    report = per_day.collect()                                        # a row per calendar day
    touched = [r for r in report if r["new"] or r["changed"] or r["gone"]]
    written = [r["view_date"] for r in touched if r["new"] or r["changed"] or r["same"]]
    if written:
        of_days = F.col("view_date").isin([d for d in written if d is not None])
        if None in written:
            of_days = F.coalesce(of_days, F.lit(False)) | F.col("view_date").isNull()
        todo = changes.where(of_days)
        fresh = read_listed(todo.where(F.col("state").isin("new", "changed")), keep=("modificationTime", "view_date"))
        old = landed_table(spark, path).where(of_days)
        stale = todo.where("state <> 'same'").select(F.col("path").alias("_p"))
        kept = old.join(stale, F.col("path") == F.col("_p"), "left_anti")  # also files of other trees and days
        rows = kept.unionByName(fresh.select(*LANDED.names)).hint("rebalance", "view_date")
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("view_date").parquet(path))
    for r in touched:
        if r["view_date"] not in written:
            _drop_day(spark, path, r["view_date"], spelled(base.rstrip("/")) + "/")
    return spark.createDataFrame([tuple(r) for r in report],
                                 "view_date date, new long, changed long, gone long, same long, bytes_read long")


def _drop_day(spark: SparkSession, path: str, day, root: str) -> None:
    """Take the files below ``root`` out of a day that keeps none of them; other trees' files stay."""
    same_day = F.col("view_date").isNull() if day is None else F.col("view_date") == F.lit(day)
    others = landed_table(spark, path).where(same_day & ~F.startswith(F.col("path"), F.lit(root)))
    if not others.isEmpty():
        (others.hint("rebalance", "view_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("view_date").parquet(path))
        return
    fs, folder = _hadoop(spark, f"{path.rstrip('/')}/view_date={NO_DATE if day is None else day.isoformat()}")
    fs.delete(folder, True)


# ---- counts taken by the write itself -------------------------------------------------------

def write_counted(df: DataFrame, write, bytes_col: str | None = None, error_col: str | None = None, name: str = "rows") -> dict:
    """Run ``write(df)`` and return the counts its own pass gathered: rows, bad rows, bytes; no second scan.

    ``bytes_col`` is a length or binary column that is summed, ``error_col`` is NULL for good rows.
    A task that runs twice (a lost executor) may be counted twice: these are figures of the run, the table is right.
    """
    seen = Observation(f"protoflow-{name}")
    counts = [F.count(F.lit(1)).alias("rows")]
    if error_col:
        counts.append(F.count(F.col(error_col)).alias("bad"))
    if bytes_col:
        size = F.octet_length(bytes_col) if isinstance(df.schema[bytes_col].dataType, T.BinaryType) else F.col(bytes_col)
        counts.append(F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))
    write(df.observe(seen, *counts))
    return gathered(seen, df, counts)


def ingest_files(spark: SparkSession, files: DataFrame, message, path: str, partition_by="view_date", keep=("view_date",),
                 change=None, **decode_options) -> DataFrame:
    """Read the listed ``files``, decode them and write the table at ``path``; found, read, bytes, rows, bad as one row.

    Every count comes from the pass that writes: ``found`` and ``bytes`` where content is read, ``rows``
    and ``bad`` where it is decoded (bad messages are counted and left out of the table).  ``change`` may
    turn the raw rows (path, length, content, view_date, view_hour) into others before they are decoded.
    """
    from ..functions.api import decode
    from ..plans.tables import write_table

    raw = with_path_partition(read_listed(files, mode="permissive"))
    seen = Observation("protoflow-read")
    sums = [F.count(F.lit(1)).alias("found"), F.count("content").alias("read"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")]
    there = raw.observe(seen, *sums).where(F.col("content").isNotNull())
    decoded = decode(change(there) if change else there, message, col="content", keep=keep, mode="permissive", **decode_options)
    done = write_counted(decoded, lambda df: write_table(df.where(F.col("_error").isNull()).drop("_error"), path=path,
                                                         partition_by=partition_by), error_col="_error")
    counts = gathered(seen, raw, sums)
    return spark.createDataFrame(
        [(counts["found"], counts["read"], counts["bytes"], done["rows"] - done["bad"], done["bad"])],
        "found long, read long, bytes long, rows long, bad long")

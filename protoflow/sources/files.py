"""Message files: listing, path-derived dates, day reads, raw landing, file writing.

One message per file, files in ``<base>/<yyyy>/<mm>/<dd>/<hh>/...``.  Everything
is one ``binaryFile`` scan: Spark packs many small files into one partition
(``spark.sql.files.maxPartitionBytes`` / ``openCostInBytes``) and never reads
``content`` unless it is selected.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import ensure_shipped, open_fs, shuffle_partitions
from ..functions.codec import _slices
from .listing import TARGET_BYTES, balanced, list_tree

DATE_HOUR = r"/(\d{4})/(\d{2})/(\d{2})/(\d{2})/"
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def _reader(spark: SparkSession, recursive: bool, glob: str | None, modified_after: str | None):
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r


def scan_files(spark: SparkSession, paths, recursive: bool = True, glob: str | None = None,
               contains: str | None = None, modified_after: str | None = None) -> DataFrame:
    """binaryFile scan of ``paths`` (str or list; globs allowed): path, modificationTime,
    length, content.  ``content`` is read only if a later projection keeps it."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _reader(spark, recursive, glob, modified_after).load(paths)
    if contains:
        df = df.where(F.col("path").contains(contains))
    return df


def list_files(spark: SparkSession, path, recursive: bool = True, glob: str | None = None,
               contains: str | None = None, modified_after: str | None = None) -> DataFrame:
    """Files only (never directories): path, modificationTime, length; content pruned."""
    return scan_files(spark, path, recursive, glob, contains, modified_after) \
        .select("path", "modificationTime", "length")


def normalize_path(c: Column | str, scheme_from: str, scheme_to: str) -> Column:
    """Rewrite a path prefix natively, e.g. a URI scheme to its local-mount spelling."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "^" + re.escape(scheme_from), scheme_to.replace("$", "\\$"))


def with_path_partition(df: DataFrame, path_col: str = "path", pattern: str = DATE_HOUR) -> DataFrame:
    """Adds ``view_date`` (date) and ``view_hour`` (int) from ``/yyyy/mm/dd/hh/`` in the path;
    NULL when the path has no such part or it is no valid date / hour."""
    p = F.col(path_col)
    y, m, d, h = (F.regexp_extract(p, pattern, i) for i in (1, 2, 3, 4))
    hit = y != F.lit("")
    # try_: a folder name that is no real date (month 13, day 45) gives NULL, not a failed job
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")))
    hour = h.try_cast("int")
    return df.withColumns({
        "view_date": F.when(hit, day),
        "view_hour": F.when(hit & hour.between(0, 23), hour),
    })


def day_paths(base: str, day: str, hours=None) -> list[str]:
    """Glob paths for one day folder (``yyyy/mm/dd``), optionally some hour folders."""
    base = base.rstrip("/")
    if hours is None:
        return [f"{base}/{day}/*"]
    # one brace glob: hours without a folder are simply not matched (a path list would
    # fail on the first missing hour)
    return [f"{base}/{day}/{{{','.join(f'{int(h):02d}' for h in hours)}}}"]


def read_raw(spark: SparkSession, base: str, day: str | None = None, hours=None,
             glob: str | None = None, contains: str | None = None) -> DataFrame:
    """Raw message files of the tree (or of one day / some hours) with view_date, view_hour.

    Day and hour selection happen in the path list given to the scan, so folders
    outside the selection are never listed (partition pruning by path).
    """
    paths = day_paths(base, day, hours) if day else [base]
    df = scan_files(spark, paths, recursive=True, glob=glob, contains=contains)
    return with_path_partition(df)


IO_THREADS = 16      # concurrent file operations per task (object stores are latency-bound)
READ_BYTES = 8 << 20    # content handed on at once by a reading task


def _read_paths(batches, path_col: str, permissive: bool, keep: tuple = ()):
    from concurrent.futures import ThreadPoolExecutor

    def read_one(p):
        try:
            fs, local = open_fs(p)
            with fs.open_input_stream(local) as fh:
                return fh.read()
        except FileNotFoundError:
            if not permissive:
                raise
            return None

    def out(batch, done, blobs):
        part = batch.slice(done, len(blobs))
        return pa.RecordBatch.from_arrays(
            [part.column(path_col), pa.array([None if b is None else len(b) for b in blobs], pa.int64()),
             pa.array(blobs, pa.binary()), *[part.column(k) for k in keep]], names=[path_col, "length", "content", *keep])

    with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
        for batch in batches:
            paths = batch.column(path_col).to_pylist()
            done, blobs, size = 0, [], 0
            for i in range(0, len(paths), IO_THREADS):           # files in flight, order preserved
                for b in pool.map(read_one, paths[i:i + IO_THREADS]):
                    blobs.append(b)
                    size += len(b or b"")
                if size >= READ_BYTES:
                    yield out(batch, done, blobs)
                    done, blobs, size = done + len(blobs), [], 0
            if blobs:
                yield out(batch, done, blobs)


def read_listed(files: DataFrame, path_col: str = "path", partitions: int | None = None,
                mode: str = "failfast", target_bytes: int = TARGET_BYTES, keep=()) -> DataFrame:
    """Content of exactly the files in ``files`` (e.g. a sample of a listing), read by the
    executors: path, length, content, and the columns of ``keep``.  The list stays distributed
    (never collected), and files outside it are never opened - a join against a full binaryFile
    scan would read every file first.

    With a ``length`` column the read is planned by bytes: each task reads a range of about
    ``target_bytes`` of the running sum of lengths (less when there is little to read, so that
    every core has some).  Without lengths, or with ``partitions`` given, paths are dealt by a
    hash to that many tasks.  A file that has gone fails the task, or has NULL content with
    ``mode="permissive"``; ``length`` is that of the content read."""
    spark, keep = files.sparkSession, tuple(keep)
    ensure_shipped(spark)
    fn = partial(_read_paths, path_col=path_col, permissive=mode == "permissive", keep=keep)
    if partitions is None and "length" in files.columns:
        dealt = balanced(files.select(path_col, "length", *keep), path_col, target_bytes=target_bytes,
                         min_partitions=shuffle_partitions(spark)).select(path_col, *keep)
    else:
        dealt = files.select(path_col, *keep).repartition(partitions or shuffle_partitions(spark), path_col)
    return dealt.mapInArrow(
        fn, T.StructType([T.StructField(path_col, T.StringType(), True),
                          T.StructField("length", T.LongType(), True),
                          T.StructField("content", T.BinaryType(), True), *[files.schema[k] for k in keep]]))


def read_messages(spark: SparkSession, base: str | None, message, day: str | None = None, hours=None,
                  glob: str | None = None, contains: str | None = None,
                  keep=("path", "view_date", "view_hour"), files: DataFrame | None = None,
                  listing: str = "scan", **decode_options) -> DataFrame:
    """Messages of the files, decoded on the executors: never a loop over files.

    ``listing="scan"`` plans one file scan (Spark's index of the files is on the driver);
    ``listing="tasks"`` lists by tasks and reads by byte ranges, for trees of any size.
    With ``files`` (a DataFrame of paths, e.g. from ``sample_files``) only those are read."""
    from ..functions.api import decode

    if listing not in ("scan", "tasks"):
        raise ValueError("listing must be 'scan' or 'tasks'")
    if files is None and listing == "tasks":
        files = list_tree(spark, base, days=day, hours=hours, glob=glob, contains=contains)
    if files is not None:
        raw = with_path_partition(read_listed(files, mode=decode_options.get("mode", "failfast")))
    else:
        raw = read_raw(spark, base, day, hours, glob, contains)
    return decode(raw, message, col="content", keep=keep, **decode_options)


def read_day(spark: SparkSession, base: str, day: str, message, hours=None, **decode_options):
    """Decoded messages of one day folder (``yyyy/mm/dd``), optionally some hours."""
    return read_messages(spark, base, message, day=day, hours=hours, **decode_options)


def land_raw_day(spark: SparkSession, base: str, day: str, path: str) -> DataFrame:
    """Copy one day of message files into a Parquet table partitioned by ``view_date``.

    Dynamic partition overwrite: a rerun replaces that day only, other days stay.
    Returns the whole landed table read back (path, modificationTime, length, content,
    view_date); ``day`` may be a glob such as ``"*/*/*"`` to land every day in one job.
    """
    # rebalanced by day: a few files per day whatever the number of scan tasks
    raw = read_raw(spark, base, day).drop("view_hour").hint("rebalance", "view_date")
    (raw.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("view_date").parquet(path))
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# Writing one message per file (Spark has no binary-file sink)
# ---------------------------------------------------------------------------
def _write_files(batches, base: str, path_col: str, content_col: str):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import TaskContext

    ctx = TaskContext.get()
    attempt = f"{ctx.stageId()}-{ctx.partitionId()}-{ctx.attemptNumber()}" if ctx else "0"
    fs, root = open_fs(base)
    made: set = set()

    def write_one(full: str, blob: bytes) -> None:
        # write a hidden per-attempt temp file, then rename it into place: a task lost
        # mid-write leaves no partial message visible (listings skip dot-files), and a
        # retry rewrites the same deterministic name with the same bytes
        parent_dir, name = full.rsplit("/", 1)
        tmp = f"{parent_dir}/.{name}.{attempt}.tmp"
        with fs.open_output_stream(tmp) as fh:
            fh.write(blob)
        fs.move(tmp, full)

    with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
        for batch in (part for b in batches for part in _slices(b, content_col, READ_BYTES)):
            rels = batch.column(path_col).to_pylist()
            blobs = batch.column(content_col).to_pylist()
            if None in blobs:                    # an empty file would read back as a message with nothing set
                raise ValueError(f"{content_col} is NULL for {rels[blobs.index(None)]!r}: no message to write")
            paths = [f"{root.rstrip('/')}/{rel.lstrip('/')}" for rel in rels]
            for parent in {p.rsplit("/", 1)[0] for p in paths} - made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            list(pool.map(write_one, paths, blobs))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()),
                                              pa.array([len(b) for b in blobs], pa.int64())],
                                             names=["file", "bytes"])


def write_message_files(df: DataFrame, base: str, path_col: str = "relpath",
                        content_col: str = "value") -> tuple[int, int]:
    """Write each row's bytes to ``base/<relpath>`` from the executors; returns (files, bytes).

    ``base`` must be a folder every executor can reach (the shared scratch folder).
    """
    ensure_shipped(df.sparkSession)
    fn = partial(_write_files, base=base, path_col=path_col, content_col=content_col)
    written = df.select(path_col, content_col).mapInArrow(fn, "file string, bytes long")
    row = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def _remove_files(batches, path_col: str):
    from concurrent.futures import ThreadPoolExecutor

    def remove(path):
        fs, local = open_fs(path)
        try:
            fs.delete_file(local)
        except FileNotFoundError:                # a repeated task finds it gone
            pass

    with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
        for batch in batches:
            list(pool.map(remove, batch.column(path_col).to_pylist()))
            yield batch.select([path_col])


def remove_message_files(files: DataFrame, path_col: str = "path") -> int:
    """Delete the files in ``files`` from the executors; returns how many paths were given."""
    ensure_shipped(files.sparkSession)
    src = files.select(path_col)
    return src.mapInArrow(partial(_remove_files, path_col=path_col), src.schema).count()

"""Streaming file ingest: the batch decode on a ``binaryFile`` stream.

Stateless (one message per file, no aggregation), so no watermark: every new
file is decoded once per checkpoint and appended to the sink.  Restarting with
the same checkpoint resumes where it stopped; the file sink's commit log makes
the output exactly-once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._session import _context, _hadoop, create_once, read_small, small_files
from ..functions.api import decode
from ..sources.files import BINARY_FILE_SCHEMA, with_path_partition
from ..sources.landing import write_counted

MAX_FILES = 10_000        # files of one batch, unless the caller says otherwise; the first one too
CACHED_FILES = 100_000    # files still to come that the source keeps; then it goes through all files again
LISTING_TASKS = 32        # that list the files of a batch, where the number of cores is not known
COMPACT_BATCHES = 100     # after so many batches the source writes the names of all files seen into one file
LEDGER = "_batches"       # folder of the sink with a file per finished batch
BATCH = "_batch"          # partition column that a batch's files lie under


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the stream's own with the settings of ``spark`` and two that fit its file source.

    Without them the source lists the files of a batch by a task for each, whose results go to the driver,
    and writes the names of all files it has seen again after every tenth batch.  They would change other
    reads of ``spark``, so they are not set there.  The query is one of this session (``query.stop()``
    and ``awaitTermination()`` as ever; the ``streams`` of ``spark`` do not list it)."""
    own, sc = spark.newSession(), _context(spark)
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(max(1, sc.defaultParallelism) if sc else LISTING_TASKS))
    own.conf.set("spark.sql.streaming.fileSource.log.compactInterval", str(COMPACT_BATCHES))
    return own


def message_stream(spark: SparkSession, base: str, message, glob: str | None = None,
                   max_files_per_trigger: int | None = MAX_FILES,
                   keep=("path", "view_date", "view_hour"), **decode_options) -> DataFrame:
    """Streaming DataFrame of decoded messages from files landing under ``base``."""
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("recursiveFileLookup", "true").option("maxCachedFiles", str(CACHED_FILES)))
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = with_path_partition(r.load(base))
    return decode(raw, message, col="content", keep=keep, **decode_options)


def ingest_stream(spark: SparkSession, base: str, message, sink: str, checkpoint: str,
                  partition_by=("view_date",), available_now: bool = True,
                  processing_time: str | None = None, fmt: str = "parquet", **decode_options):
    """Start the stream into an append-only ``fmt`` sink; returns the StreamingQuery.

    ``available_now`` processes everything present and stops (batch-like daily runs);
    otherwise it polls every ``processing_time``."""
    stream = message_stream(stream_session(spark), base, message, **decode_options)
    w = (stream.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def record_stream(spark: SparkSession, topic: str, registry, reader, value_col: str = "value",
                  keep=(), max_files_per_trigger: int | None = MAX_FILES, **decode_options) -> DataFrame:
    """Streaming decode of registry-framed records (a ``value`` binary column, as a message
    bus delivers them) landing as Parquet files under ``topic``: the header is parsed
    natively and each payload is read into ``reader`` whatever version wrote it."""
    from ..operators.registry import decode_registered

    r = spark.readStream.format("parquet").schema(_topic_schema(spark, topic, value_col, keep))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return decode_registered(r.load(topic), registry, reader, col=value_col, keep=keep, **decode_options)


def _topic_schema(spark: SparkSession, topic: str, value_col: str, keep):
    from pyspark.sql import types as T

    fields = [T.StructField(value_col, T.BinaryType(), True)]
    known = spark.read.parquet(topic).schema
    fields += [known[k] for k in keep]
    return T.StructType(fields)


def ingest_records(spark: SparkSession, topic: str, registry, reader, sink: str, checkpoint: str,
                   keep=(), available_now: bool = True, **decode_options):
    """Start ``record_stream`` into an append-only Parquet sink; returns the StreamingQuery."""
    stream = record_stream(stream_session(spark), topic, registry, reader, keep=keep, **decode_options)
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def ingest_days(spark: SparkSession, base: str, message, sink: str, bad_sink: str, checkpoint: str, glob: str | None = None,
                max_files_per_trigger: int | None = MAX_FILES, keep=("path", "view_date", "view_hour"),
                available_now: bool = True, processing_time: str | None = None, **decode_options):
    """Start a stream of message files into two tables: decoded rows in ``sink``, unreadable messages in ``bad_sink``.

    Both are Parquet, partitioned by ``view_date`` and the batch.  A batch overwrites its own
    partitions and then enters its counts in the sink's ledger, a file created once; a batch that is
    repeated after a crash finds its entry and does nothing, or finds none and replaces what it had
    written.  So each file is in exactly one of the tables, once, whenever the run was cut off.
    ``bad_sink`` holds path, view_date, length, content and ``_error``, enough to read them again.
    """
    raw = (stream_session(spark).readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
           .option("recursiveFileLookup", "true").option("maxCachedFiles", str(CACHED_FILES)))
    if glob:
        raw = raw.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        raw = raw.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = with_path_partition(raw.load(base))
    keep = tuple(dict.fromkeys([*keep, "view_date"]))

    def batch(df: DataFrame, number: int) -> None:
        _land_batch(df, int(number), message, sink, bad_sink, keep, decode_options)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _entry(sink: str, number: int) -> str:
    return f"{sink.rstrip('/')}/{LEDGER}/{number:012d}.json"


def _land_batch(df: DataFrame, number: int, message, sink: str, bad_sink: str, keep: tuple, decode_options: dict) -> None:
    spark = df.sparkSession
    if _is_there(spark, _entry(sink, number)):
        return
    also = [c for c in ("path", "view_date", "length", "content") if c not in keep]
    decoded = decode(df, message, col="content", keep=(*keep, *also), mode="permissive", **decode_options)
    failed = F.col("_error").isNotNull()
    # dealt by day once for both tables, bytes only of bad messages
    decoded = decoded.withColumns({c: F.when(failed, F.col(c)) for c in also if c != "view_date"} | {BATCH: F.lit(number)})
    decoded = decoded.hint("rebalance", "view_date").persist()
    try:
        good = decoded.where(~failed).drop("_error", *also)
        bad = decoded.where(failed).select("path", "view_date", "length", "content", "_error", BATCH)
        counts = {"rows": write_counted(good, lambda d: _replace(d, sink), name="good")["rows"],
                  "bad": write_counted(bad, lambda d: _replace(d, bad_sink), name="bad")["rows"]}
    finally:
        decoded.unpersist()
    create_once(spark, _entry(sink, number), json.dumps({"batch": number, **counts}).encode())


def _is_there(spark: SparkSession, uri: str) -> bool:
    fs, path = _hadoop(spark, uri)
    return fs.exists(path)


def _replace(df: DataFrame, path: str) -> None:
    """Write rows over the partitions they belong to."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("view_date", BATCH).parquet(path))


def finished_batches(spark: SparkSession, sink: str) -> dict[int, dict]:
    """{batch: its ledger entry} of the batches that are wholly in the tables."""
    entries = [json.loads(read_small(spark, f)) for f in small_files(spark, f"{sink.rstrip('/')}/{LEDGER}")]
    return {e["batch"]: e for e in entries}

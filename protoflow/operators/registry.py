"""Schema registry as a small table, framed records, and mixed-version decode.

Registry rows: subject, schema_id, version, message_name, fingerprint, descriptor_set.
Framed record = byte 0 (magic ``0x00``) + 4-byte big-endian schema id + payload.
Framing and unframing are native Spark expressions (code-generated); only the
payload parse runs in Python.  Rows written under different schema ids are
decoded in one pass into one reader schema: no rescan per id, and no ids are
collected from the data.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._session import create_once
from ..functions.api import decode, encode
from ..functions.compat import closure_fingerprint, require
from ..functions.schema import build_plan

REGISTRY_SCHEMA = T.StructType([
    T.StructField("subject", T.StringType(), False),
    T.StructField("schema_id", T.IntegerType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("message_name", T.StringType(), False),
    T.StructField("fingerprint", T.StringType(), False),
    T.StructField("descriptor_set", T.BinaryType(), False),
])
MAX_REGISTRY_BYTES = 64 << 20   # of descriptors in a task's closure; checked before they are collected
CLAIM_TRIES = 50


def empty_registry(spark: SparkSession) -> DataFrame:
    """A registry table with no schemas yet."""
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def save_registry(registry: DataFrame, path: str) -> None:
    """Append the rows of ``registry`` that ``path`` (a Parquet folder) does not hold yet.

    Ids are given by one writer at a time: ``load_registry``, ``register_schema``, ``save_registry``.
    An id that the folder holds with another schema is an error and nothing is written.
    """
    spark = registry.sparkSession
    old = load_registry(spark, path).select("schema_id", F.struct("subject", "fingerprint").alias("_old"))
    both = registry.join(old, "schema_id", "left")
    bad = both.where(F.col("_old").isNotNull() & (F.col("_old") != F.struct("subject", "fingerprint"))) \
        .select("schema_id").first()
    if bad is not None:
        raise ValueError(f"schema id {bad[0]} is saved with another schema; load the registry and register again")
    new = both.where(F.col("_old").isNull()).drop("_old").select(*REGISTRY_SCHEMA.names)
    new.coalesce(1).write.mode("append").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry saved at ``path``; no schemas if the folder is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty_registry(spark)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def _fingerprint(desc_set: bytes, message: str) -> str:
    return closure_fingerprint(desc_set, message)


def register_schema(registry: DataFrame, subject: str, message, compatibility: str = "none") -> tuple[DataFrame, int]:
    """Add (subject, schema) unless present; returns (registry, schema_id).

    Idempotent: the same subject and schema always get the id they got first.
    Ids are global (max + 1); versions count per subject.  One aggregation job.  With
    ``compatibility`` (``backward``, ``forward``, ``full``) a schema that breaks it with the
    subject's newest version is an ``IncompatibleSchema`` error.  For several writers: ``RegistryLog``.
    """
    desc_set, name = message
    fp = _fingerprint(desc_set, name)
    found, top, version, newest = _standing(registry, subject, fp)
    if found is not None:
        return registry, found
    if newest is not None and compatibility != "none":
        require(compatibility, newest, message)
    row = registry.sparkSession.createDataFrame(
        [(subject, top + 1, version + 1, name, fp, bytearray(desc_set))], REGISTRY_SCHEMA)
    return registry.unionByName(row), top + 1


def _standing(registry: DataFrame, subject: str, fp: str):
    """(id of this subject and schema or None, highest id, versions of the subject, newest schema or None)."""
    same = F.col("subject") == subject
    stats = registry.agg(
        F.min(F.when(same & (F.col("fingerprint") == fp), F.col("schema_id"))).alias("found"),
        F.coalesce(F.max("schema_id"), F.lit(0)).alias("m"),
        F.count(F.when(same, 1)).alias("v"),
        F.max(F.when(same, F.struct("version", "descriptor_set", "message_name"))).alias("newest")).first()
    newest = stats["newest"]
    return (None if stats["found"] is None else int(stats["found"]), int(stats["m"]), int(stats["v"]),
            None if newest is None else (bytes(newest["descriptor_set"]), newest["message_name"]))


class RegistryLog:
    """A registry kept as a numbered log in a shared folder, safe with several writers.

    Entry ``n`` is the file ``<n>.json`` and holds the schema with id ``n``; it is created only if it
    is absent, so an id is given once.  A writer that loses an id reads the log again: the schema
    may have got an id meanwhile, else it tries the next.  Entries never change.
    """

    ENTRY = "subject string, schema_id int, version int, message_name string, fingerprint string, descriptor_set string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> DataFrame:
        """The registry table, in the order of no promise; no rows if nothing is registered."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return empty_registry(self.spark)
        rows = self.spark.read.schema(self.ENTRY).json(self.path)
        return rows.withColumn("descriptor_set", F.unbase64("descriptor_set")).select(*REGISTRY_SCHEMA.names)

    def register(self, subject: str, message, compatibility: str = "none") -> int:
        """The id of (subject, schema), given now unless it has one; see ``register_schema``."""
        desc_set, name = message
        fp = _fingerprint(desc_set, name)
        for _ in range(CLAIM_TRIES):
            found, top, version, newest = _standing(self.load(), subject, fp)
            if found is not None:
                return found
            if newest is not None and compatibility != "none":
                require(compatibility, newest, message)
            entry = {"subject": subject, "schema_id": top + 1, "version": version + 1, "message_name": name,
                     "fingerprint": fp, "descriptor_set": base64.b64encode(desc_set).decode()}
            if create_once(self.spark, f"{self.path}/{top + 1:010d}.json", json.dumps(entry).encode()):
                return top + 1
        raise RuntimeError(f"{CLAIM_TRIES} ids in a row went to other writers; try again")


def registry_snapshot(registry) -> dict[int, tuple[bytes, str, str, int]]:
    """{schema_id: (descriptor_set, message_name, subject, version)}.

    A registry is a catalog of schema versions, not data: it is read with one collect after its
    bytes were checked against ``MAX_REGISTRY_BYTES``, and shipped inside the task closure.
    Passing a snapshot back in skips the read.
    """
    if isinstance(registry, dict):
        return registry
    size = _bytes_of(registry)
    if size > MAX_REGISTRY_BYTES:
        raise ValueError(f"the schemas take {size} bytes, over the {MAX_REGISTRY_BYTES} that go into a task; "
                         "give a part of the registry (a subject, a message, the ids in use)")
    rows = registry.select("schema_id", "descriptor_set", "message_name", "subject", "version").collect()
    return {int(r["schema_id"]): (bytes(r["descriptor_set"]), r["message_name"], r["subject"],
                                  int(r["version"])) for r in rows}


def _bytes_of(registry: DataFrame) -> int:
    return int(registry.agg(F.coalesce(F.sum(F.octet_length("descriptor_set") + 100), F.lit(0))).first()[0])


def used_schemas(registry: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The registry's rows whose id occurs in ``ids``: one aggregation of the ids, then a join."""
    return registry.join(ids.select(F.col(id_col).alias("schema_id")).distinct(), "schema_id", "left_semi") \
        .select(*REGISTRY_SCHEMA.names)


def registry_map(registry) -> dict[int, tuple[bytes, str]]:
    """{schema_id: (descriptor_set, message_name)} from a registry or a snapshot."""
    return {k: (v[0], v[1]) for k, v in registry_snapshot(registry).items()}


def frame(df: DataFrame, col: str, schema_id, out: str | None = None) -> DataFrame:
    """Prefix ``col`` with the 5-byte header; ``schema_id`` is an int or a column name."""
    if isinstance(schema_id, int):
        if not 0 <= schema_id < 2**31:
            raise ValueError(f"schema id {schema_id} outside 0..2^31-1")
        sid = F.lit(schema_id)
    else:
        raw = F.col(schema_id).cast("long")
        sid = F.when(raw.between(0, 2**31 - 1), raw).otherwise(
            F.raise_error(F.concat(F.lit("schema id outside 0..2^31-1: "), raw.cast("string"))))
    header = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(sid), 8, "0")))
    return df.withColumn(out or col, F.concat(header, F.col(col)))


def unframe(df: DataFrame, col: str) -> DataFrame:
    """Adds ``_magic``, ``_schema_id``, ``_payload`` parsed from the header natively."""
    b = F.col(col)
    return df.withColumns({
        "_magic": F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).try_cast("int"),
        "_schema_id": F.conv(F.hex(F.substring(b, 2, 4)), 16, 10).try_cast("int"),   # NULL if > int
        "_payload": F.expr(f"substring(`{col}`, 6)"),
    })


def encode_registered(df: DataFrame, registry: DataFrame, subject: str | None = None,
                      schema_id=None, cols=None, col: str | None = None, out: str = "value",
                      keep=()) -> DataFrame:
    """Encode with the registered schema(s) and frame the bytes.

    ``schema_id`` is an int (one schema for all rows) or a column name holding each
    row's writer schema id (mixed versions in one pass).
    """
    if isinstance(registry, DataFrame):
        # only the schemas that can occur travel with the tasks
        if isinstance(schema_id, int):
            registry = registry.where(F.col("schema_id") == schema_id)
        elif schema_id is None and subject is not None:
            registry = registry.where(F.col("subject") == subject)
        if isinstance(schema_id, str) and _bytes_of(registry) > MAX_REGISTRY_BYTES:
            registry = used_schemas(registry, df, schema_id)
    snap = registry_snapshot(registry)
    reg = {k: (v[0], v[1]) for k, v in snap.items()}
    keep = tuple(keep)
    if isinstance(schema_id, str):
        if cols is None and col is None:
            names = set()
            for ds, mn in reg.values():
                names |= {n.name for n in build_plan(ds, mn)}
            cols = [c for c in df.columns if c in names]
        enc = encode(df, next(iter(reg.values())), cols=cols, col=col, out=out,
                     keep=tuple(dict.fromkeys([*keep, schema_id])), _registry=reg, _id_col=schema_id)
        framed = frame(enc, out, schema_id)
        return framed.select(*keep, out) if schema_id not in keep else framed
    if schema_id is None:
        if subject is None:
            raise ValueError("give schema_id or subject")
        versions = [(v[3], sid) for sid, v in snap.items() if v[2] == subject]
        if not versions:
            raise ValueError(f"subject {subject!r} is not registered")
        schema_id = max(versions)[1]
    enc = encode(df, reg[int(schema_id)], cols=cols, col=col, out=out, keep=keep)
    return frame(enc, out, int(schema_id))


def decode_registered(df: DataFrame, registry: DataFrame, reader, col: str = "value",
                      keep=(), mode: str = "failfast", subject: str | None = None, **decode_options) -> DataFrame:
    """Unframe natively, then parse every payload into the ``reader`` schema.

    Writers' extra tags are skipped and the reader's new fields stay NULL (the
    wire format is tag-addressed).  A schema id must be registered for the reader's message
    (and ``subject``, if given); any other id or a bad magic byte fails the task, or gives a
    NULL row + ``_error`` when permissive.  If the message's schemas are too large for a task's
    closure, only those of the ids that occur in ``df`` are shipped (one more pass over the headers).
    """
    keep = tuple(keep)
    un = unframe(df, col)
    un = un.withColumn("_schema_id", F.when(F.col("_magic") == 0, F.col("_schema_id")))
    if isinstance(registry, dict):
        mine = {k: v for k, v in registry.items() if v[1] == reader[1] and subject in (None, v[2])}
    else:
        mine = registry.where(F.col("message_name") == reader[1])
        mine = mine if subject is None else mine.where(F.col("subject") == subject)
        if not df.isStreaming and _bytes_of(mine) > MAX_REGISTRY_BYTES:
            mine = used_schemas(mine, un, "_schema_id")
    reg = registry_map(mine)
    return decode(un, reader, col="_payload", keep=tuple(dict.fromkeys([*keep, "_schema_id"])),
                  mode=mode, _registry=reg, _id_col="_schema_id", **decode_options)

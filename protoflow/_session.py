"""Session plumbing: ship the package to Python workers, find the shared scratch folder."""

from __future__ import annotations

import io
import os
import re
import tempfile
import threading
import uuid
import zipfile
from urllib.parse import quote

_SHIPPED: set = set()
_LOCK = threading.Lock()


def _package_zip() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _subdirs, files in os.walk(root):
            if "__pycache__" in d:
                continue
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, parent))
    return buf.getvalue()


def _context(spark):
    """The SparkContext, or None on Spark Connect (no JVM handle on the client)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001
        return None


def _app_key(spark) -> str:
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return f"connect-{getattr(spark, 'session_id', id(spark))}"


def ensure_shipped(spark) -> None:
    """Make ``protoflow`` importable in every Python worker (once per application).

    Functions handed to ``mapInArrow`` are pickled by reference, so workers must be
    able to import the package; ``addPyFile`` distributes a zip of it through
    Spark's own file server (the same thing ``--py-files`` does).  On Spark Connect
    the zip is sent with ``addArtifacts(pyfile=True)``.
    """
    key = _app_key(spark)
    if key in _SHIPPED:
        return
    with _LOCK:
        if key in _SHIPPED:
            return
        data = _package_zip()
        path = _publish_zip(spark, data)
        sc = _context(spark)
        if sc is not None:
            sc.addPyFile(path)
        else:
            spark.addArtifacts(path, pyfile=True)
        _SHIPPED.add(key)


def _publish_zip(spark, data: bytes) -> str:
    """Put the package zip in the shared scratch folder (content-addressed name); if that folder cannot be
    written from here, a file of the driver does, which ``addPyFile`` serves to the executors itself."""
    import hashlib

    name = f"protoflow-{hashlib.sha1(data).hexdigest()[:16]}.zip"
    try:
        uri = f"{scratch_dir(spark)}/protoflow/pkg/{name}"
        fs, path = open_fs(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as fh:
            fh.write(data)
        return uri
    except (OSError, ValueError, ImportError):       # e.g. no pyarrow driver for the shared filesystem
        folder = tempfile.mkdtemp(prefix="protoflow-py-")
        local = os.path.join(folder, name)
        with open(local, "wb") as fh:
            fh.write(data)
        return local


def scratch_dir(spark) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset on a local master (tests) a folder is
    created and registered as the checkpoint dir.  On a cluster that is an error: each
    executor would write to its own disk.
    """
    sc = _context(spark)
    d = sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001
            d = None
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is not None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="protoflow-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(local)
            d = sc.getCheckpointDir() or local
        else:
            d = local
    return d.rstrip("/")


def new_scratch(spark, kind: str) -> str:
    """A fresh sub-folder of the shared scratch folder, unique per call."""
    return f"{scratch_dir(spark)}/protoflow/{kind}-{uuid.uuid4().hex[:12]}"


def open_fs(uri: str):
    """(pyarrow FileSystem, path) for a URI or plain path, usable inside tasks."""
    import pyarrow.fs as pafs

    scheme, _, rest = uri.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri) else ("", "", uri)
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme else rest
    if scheme == "dbfs":                                  # mounted on every node
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    # Hadoop spells paths as they are; a URI needs '#', '?', '%' and spaces quoted
    same = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    fs, path = pafs.FileSystem.from_uri(f"{same}:{quote(rest, safe='/:@')}")
    return fs, path


def _hadoop(spark, uri: str):
    """(FileSystem, Path) of the session's file system layer, for small files on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def create_once(spark, uri: str, data: bytes) -> bool:
    """Create a small file with ``data`` unless it is there; False if another writer was first.

    The content appears at once: it is written aside and then linked (local folders) or renamed to
    its name.  A rename onto an existing name fails on HDFS and the stores that follow it; a store
    without an exclusive rename gives no protection against two writers at the same instant.
    """
    fs, path = _hadoop(spark, uri)
    aside = f"{uri.rsplit('/', 1)[0]}/.{uri.rsplit('/', 1)[1]}.{uuid.uuid4().hex}"
    if fs.getUri().getScheme() == "file":
        local, tmp = path.toUri().getPath(), spark._jvm.org.apache.hadoop.fs.Path(aside).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(tmp, "wb") as fh:
            fh.write(data)
        try:
            os.link(tmp, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(tmp)
    _, tmp = _hadoop(spark, aside)
    stream = fs.create(tmp, False)
    stream.write(bytearray(data))
    stream.close()
    if not fs.exists(path) and fs.rename(tmp, path):
        return True
    fs.delete(tmp, False)
    return False


def small_files(spark, folder: str) -> list[str]:
    """Sorted paths of the files directly in ``folder`` without hidden ones; none if it is not there."""
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(str(f.getPath()) for f in fs.listStatus(path)
                  if f.isFile() and not f.getPath().getName().startswith("."))


def read_small(spark, uri: str) -> bytes:
    """The bytes of one small file."""
    fs, path = _hadoop(spark, uri)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def gathered(seen, df, counts: list) -> dict:
    """What an ``Observation`` gathered.  A write that turns out to have no rows is cut short by the optimizer, and
    its observation with it: only then are the rows counted by a pass of their own."""
    try:
        found = dict(seen.get)
    except Exception:  # noqa: BLE001 - the session has no row for a plan that was cut short
        found = {}
    return found if found else df.agg(*counts).first().asDict()


def write_observed(df, path: str, *counts) -> dict:
    """Write ``df`` as Parquet and return aggregates of its rows, taken by the write itself.

    A task that runs twice may be counted twice, so the counts serve decisions and reports, not results.
    """
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, *counts).write.parquet(path)
    return gathered(seen, df, list(counts))


def spread(df, min_partitions: int | None = None):
    """Give a Python-heavy stage at least one partition per core.

    Decode/encode cost is per message, so a single-file table read as one split
    would run on one core.  A scan of a large table already has enough splits
    and passes through unchanged (no extra shuffle); only a small input is
    round-robin repartitioned, which moves little data.
    """
    if df.isStreaming:
        return df
    sc = _context(df.sparkSession)
    if sc is None:                       # Spark Connect: no RDD view of the plan
        return df
    want = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def shuffle_partitions(spark) -> int:
    """The session's shuffle width (read, never changed), at least one per core."""
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        n = 200
    sc = _context(spark)
    return max(n, sc.defaultParallelism if sc is not None else 1)

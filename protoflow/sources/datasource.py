"""Message files as a Spark data source: ``spark.read.format("protoflow_files")`` and its writer.

Reading: the driver plans folders (one partition per hour folder, or several with ``splits``), never
files; a task lists its folder and reads the files.  ``days`` and ``hours`` options, or filters on
``view_date`` and ``view_hour`` with ``push``, leave out folders before they are opened.

Writing: a task writes its rows aside and moves them to their names when it is done; a task that
fails moves nothing, and a job that fails takes back what its finished tasks had moved.

    register(spark)
    spark.read.format("protoflow_files").option("hours", "0,5").load(base)
    df.select("relpath", "content").write.format("protoflow_files").mode("append").save(base)
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass
from fnmatch import fnmatchcase
from zlib import crc32

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from .._session import _app_key, ensure_shipped, open_fs
from .files import IO_THREADS, READ_BYTES
from .listing import _open_folder, _selected, spelled

NAME = "protoflow_files"
SCHEMA = "path string, modificationTime timestamp, length long, content binary, view_date date, view_hour int"
STAGING = "_staging"          # folder below the base for files of unfinished tasks; listings skip its name
_HOUR_FOLDER = re.compile(r"(\d{4})/(\d{2})/(\d{2})/(\d{2})(?:/|$)")
_REGISTERED: set = set()


def register(spark: SparkSession) -> None:
    """Make the source known to the session (once per application and session)."""
    ensure_shipped(spark)
    key = (_app_key(spark), id(spark))
    if key not in _REGISTERED:
        spark.dataSource.register(MessageFiles)
        _REGISTERED.add(key)


@dataclass
class FolderPartition(InputPartition):
    """Files of one folder (and below it, if ``deep``) whose hashed name falls to ``split`` of ``splits``."""
    folder: str
    depth: int
    deep: bool
    split: int
    splits: int

    def __init__(self, folder, depth, deep, split, splits):
        super().__init__(None)
        self.folder, self.depth, self.deep, self.split, self.splits = folder, depth, deep, split, splits


class MessageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        push = str(self.options.get("push", "false")).lower() == "true"
        return (PushingReader if push else FolderReader)(self.options)

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError(f"{NAME} replaces files by name: write with mode('append')")
        return FileWriter(self.options, [f.name for f in schema.fields])


def _date_and_hour(below: str):
    """(date, hour) of a folder path below the base; None where it has no valid one."""
    found = _HOUR_FOLDER.match(below.lstrip("/"))
    if not found:
        return None, None
    y, m, d, h = map(int, found.groups())
    try:
        day = dt.date(y, m, d)
    except ValueError:
        day = None
    return day, h if h < 24 else None


class FolderReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError(f"{NAME} needs a path")
        self.base = spelled(options["path"].rstrip("/") or "/")
        days, hours = options.get("days"), options.get("hours")
        self.days = [d.strip().strip("/") for d in days.split(",")] if days else ["*/*/*"] if hours else None
        self.hours = {f"{int(h):02d}" for h in hours.split(",")} if hours else None
        self.glob = options.get("pathglobfilter") or options.get("pathGlobFilter")
        self.splits = int(options.get("splits", 1))
        self.tests: list = []                    # (column, test of a value) pushed by Spark

    def _wanted(self, below: str, depth: int) -> bool:
        if depth and not _selected(below.strip("/").split("/"), self.days, self.hours):
            return False
        if depth < 4:                            # a filter can speak once day and hour are known
            return True
        day, hour = _date_and_hour(below)
        return all(v is not None and test(v) for v, test in
                   ((day if c == "view_date" else hour, test) for c, test in self.tests))

    def partitions(self):
        """Folders down to the hour, listed level by level; files are left to the tasks."""
        from concurrent.futures import ThreadPoolExecutor

        bounded = self.days is not None or bool(self.tests)      # loose files have no day or hour
        out, level = [], [self.base]
        with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
            for depth in range(5):
                if depth == 4:
                    break
                found = list(pool.map(lambda f: _open_folder(self.base, depth, f), level))
                if not bounded:
                    out += [(f, depth, False) for f, (_, files) in zip(level, found) if files]
                level = [f for folders, _ in found for f in folders if self._wanted(f[len(self.base):], depth + 1)]
        # a day selected without hours also keeps the files directly in its folder, as the path scan does
        out += [(f, 4, True) for f in level]
        if bounded and self.hours is None and not self.tests:
            out += [(d, 3, False) for d in sorted({f.rsplit("/", 1)[0] for f in level})]
        return [FolderPartition(*f, i, self.splits) for f in out for i in range(self.splits)] or \
            [FolderPartition("", 0, False, 0, 1)]

    def _files(self, part: FolderPartition):
        level = [(part.folder, part.depth)] if part.folder else []
        while level:
            folder, depth = level.pop()
            folders, files = _open_folder(self.base, depth, folder)
            for name, path, mtime, size in files:
                if (self.glob is None or fnmatchcase(name, self.glob)) and crc32(name.encode()) % part.splits == part.split:
                    yield folder, path, mtime
            level += [(f, depth + 1) for f in folders] if part.deep else []

    def read(self, partition):
        from concurrent.futures import ThreadPoolExecutor

        def fetch(path):
            fs, local = open_fs(path)
            with fs.open_input_stream(local) as fh:
                return fh.read()

        def batch(rows):
            when = [_date_and_hour(f[len(self.base):]) for f, _, _, _ in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.timestamp("us", tz="UTC")),
                 pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
                 pa.array([w[0] for w in when], pa.date32()), pa.array([w[1] for w in when], pa.int32())],
                names=["path", "modificationTime", "length", "content", "view_date", "view_hour"])

        rows, size, wave = [], 0, []
        with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
            def arrive():
                nonlocal size
                for (folder, path, mtime), data in zip(wave, pool.map(fetch, [p for _, p, _ in wave])):
                    rows.append((folder, path, mtime, data))
                    size += len(data)
                wave.clear()

            for found in self._files(partition):
                wave.append(found)
                if len(wave) == IO_THREADS:
                    arrive()
                    if size >= READ_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            arrive()
        if rows:
            yield batch(rows)


class PushingReader(FolderReader):
    """Takes filters on ``view_date`` and ``view_hour`` (``spark.sql.python.filterPushdown.enabled``)."""

    TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b,
             GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}

    def pushFilters(self, filters):
        for f in filters:
            test = self.TESTS.get(type(f))
            if test is not None and f.attribute in (("view_date",), ("view_hour",)):
                self.tests.append((f.attribute[0], lambda v, t=test, w=f.value: t(v, w)))
            else:
                yield f


@dataclass
class Published(WriterCommitMessage):
    """Where a finished task's list of files lies; the list itself does not travel to the driver."""
    manifest: str
    files: int


class FileWriter(DataSourceArrowWriter):
    """Rows (``relpath``, ``content``) to files; ``content`` must not be NULL."""

    def __init__(self, options, columns: list[str]):
        if not options.get("path"):
            raise ValueError(f"{NAME} needs a path")
        if not {"relpath", "content"} <= set(columns):
            raise ValueError(f"{NAME} writes the columns relpath and content, not {columns}")
        self.base = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def _staging(self, fs_root: str) -> str:
        return f"{fs_root}/{STAGING}/{self.job}"

    def write(self, iterator):
        from concurrent.futures import ThreadPoolExecutor

        from pyspark import TaskContext

        fs, root = open_fs(self.base)
        ctx = TaskContext.get()
        aside = f"{self._staging(root)}/{ctx.partitionId()}-{ctx.taskAttemptId()}"
        fs.create_dir(aside, recursive=True)
        n, made = 0, set()

        def put(item):
            i, data = item
            with fs.open_output_stream(f"{aside}/{i}") as fh:
                fh.write(data)

        manifest = f"{aside}/manifest"
        with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
            with fs.open_output_stream(manifest) as names:
                for batch in iterator:
                    rels = [r.lstrip("/") for r in batch.column("relpath").to_pylist()]
                    blobs = batch.column("content").to_pylist()
                    if None in blobs:
                        raise ValueError(f"content is NULL for {rels[blobs.index(None)]!r}: no message to write")
                    list(pool.map(put, zip(range(n, n + len(blobs)), blobs)))
                    for r in rels:
                        names.write(f"{r}\n".encode())
                    n += len(blobs)

            with fs.open_output_stream(f"{aside}/moving"):       # from here on there may be something to take back
                pass

            def move(item):
                i, rel = item
                fs.move(f"{aside}/{i}", f"{root}/{rel}")

            for part in _lines(fs, manifest):
                for folder in {f"{root}/{rel}".rsplit("/", 1)[0] for _, rel in part} - made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                list(pool.map(move, part))
        return Published(manifest, n)

    def commit(self, messages) -> None:
        self._clear()

    def abort(self, messages) -> None:
        """Take back what any task of the job has moved, then remove the files aside.

        The folder aside is renamed first: a task that still runs finds its files gone and moves no more.
        """
        import pyarrow.fs as pafs
        from concurrent.futures import ThreadPoolExecutor

        fs, root = open_fs(self.base)
        if fs.get_file_info(self._staging(root)).type != pafs.FileType.Directory:
            return
        stopped = self._staging(root) + ".stopped"
        fs.move(self._staging(root), stopped)

        def take_back(item):
            aside, i, rel = item
            if fs.get_file_info(f"{aside}/{i}").type == pafs.FileType.NotFound:      # it was moved
                try:
                    fs.delete_file(f"{root}/{rel}")
                except FileNotFoundError:
                    pass

        with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
            for info in fs.get_file_info(pafs.FileSelector(stopped)):
                manifest = f"{info.path}/manifest"
                if fs.get_file_info(manifest).type == pafs.FileType.File and fs.get_file_info(f"{info.path}/moving").type \
                        == pafs.FileType.File:
                    for part in _lines(fs, manifest):
                        list(pool.map(take_back, [(info.path, i, rel) for i, rel in part]))
        fs.delete_dir(stopped)
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as pafs

        fs, root = open_fs(self.base)
        for folder in (self._staging(root), f"{root}/{STAGING}"):
            info = fs.get_file_info(folder)
            if info.type == pafs.FileType.Directory and (
                    folder != f"{root}/{STAGING}" or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


def _lines(fs, manifest: str, size: int = 10_000):
    """(number, line) of a manifest in parts of bounded size."""
    part: list = []
    with fs.open_input_stream(manifest) as raw:
        import io

        for i, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8", newline="\n")):
            part.append((i, line.rstrip("\n")))
            if len(part) >= size:
                yield part
                part = []
    if part:
        yield part

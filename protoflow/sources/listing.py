"""Listing of large file trees by tasks, and read plans balanced by bytes.

A scan with Spark's file source keeps one status per file on the driver.  Here folders are
listed in rounds: tasks open the folders of the frontier, write the files they find to a table
in the shared folder, and hand on the folders they did not open.  The driver learns only how
many folders are left.  Day and hour selection is applied to folders before they are opened.
"""

from __future__ import annotations

from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._session import ensure_shipped, new_scratch, open_fs, shuffle_partitions, write_observed

IO_THREADS = 16               # folders in flight per task
ROUND_FOLDERS = 256           # a task descends below its own folders until it has opened so many
LIST_ROWS = 10_000            # rows per Arrow batch of a listing
WALK_SCHEMA = "kind string, path string, depth int, modificationTime timestamp, length long"

TARGET_BYTES = 128 << 20      # of a read partition
FILE_COST = 256 << 10         # bytes that opening a file counts as
MAX_PARTITIONS = 100_000      # of a read plan; with more bytes the target grows
CELL_FILES = 50_000           # files ranked in one task


# ---- listing ------------------------------------------------------------------------------

def spelled(path: str) -> str:
    """A path as Spark's file scans spell it (local ones with the ``file:`` scheme)."""
    if path.startswith("/"):
        return "file:" + path
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _selected(parts: list[str], days, hours) -> bool:
    """Whether a folder below the base may hold selected files: yyyy/mm/dd/hh, compared as deep as it goes."""
    if days is None:
        return True
    for day in days:
        want = day.split("/")
        if all(fnmatchcase(p, w) for p, w in zip(parts, want)):
            if hours is None or len(parts) <= len(want) or parts[len(want)] in hours:
                return True
    return False


def _file_kept(parts: list[str], name: str, days, hours, glob, contains, after, path, mtime_us) -> bool:
    if days is not None:
        depth = min(len(d.split("/")) for d in days) + (hours is not None)
        if len(parts) < depth:
            return False
    return ((glob is None or fnmatchcase(name, glob)) and (contains is None or contains in path)
            and (after is None or mtime_us > after))


def _open_folder(base: str, depth: int, folder: str):
    """([sub-folder paths], [(name, path, mtime in microseconds, size)]) of one folder, hidden entries left out."""
    import pyarrow.fs as pafs

    fs, local = open_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(local, recursive=False, allow_not_found=depth > 0))
    folders, files = [], []
    for info in found:
        name = info.base_name
        if name[:1] in "._":
            continue
        path = f"{folder.rstrip('/')}/{name}"
        if info.type == pafs.FileType.Directory:
            folders.append(path)
        elif info.type == pafs.FileType.File:
            files.append((name, path, (info.mtime_ns or 0) // 1_000_000 * 1000, info.size))
    return folders, files


def _walk(batches, base: str, days, hours, glob, contains, after, max_depth):
    """Frontier rows -> opened folders, their files, and folders left for the next round."""
    from concurrent.futures import ThreadPoolExecutor

    rows: list = []

    def out():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.timestamp("us", tz="UTC")), pa.array(columns[4], pa.int64())],
            names=["kind", "path", "depth", "modificationTime", "length"])

    def below(path: str) -> list[str]:
        return path[len(base):].strip("/").split("/") if len(path) > len(base) else []

    opened = 0
    with ThreadPoolExecutor(max_workers=IO_THREADS) as pool:
        for batch in batches:
            level = list(zip(batch.column("path").to_pylist(), batch.column("depth").to_pylist()))
            while level:
                deeper = []
                for i in range(0, len(level), IO_THREADS):
                    part = level[i:i + IO_THREADS]
                    for (folder, depth), (folders, files) in zip(part, pool.map(
                            lambda x: _open_folder(base, x[1], x[0]), part)):
                        opened += 1
                        rows.append(("folder", folder, depth, None, len(files)))
                        parts = below(folder)
                        for name, path, mtime, size in files:
                            if _file_kept(parts, name, days, hours, glob, contains, after, path, mtime):
                                rows.append(("file", path, depth, mtime, size))
                            if len(rows) >= LIST_ROWS:
                                yield out()
                        if max_depth is None or depth < max_depth:
                            deeper += [(f, depth + 1) for f in folders if _selected(below(f), days, hours)]
                level = deeper if opened < ROUND_FOLDERS else []
                for f, depth in deeper if not level else []:
                    rows.append(("left", f, depth, None, None))
                    if len(rows) >= LIST_ROWS:
                        yield out()
    if rows:
        yield out()


def walk_tree(spark: SparkSession, base: str, days=None, hours=None, glob: str | None = None, contains: str | None = None,
              modified_after=None, max_depth: int | None = None) -> DataFrame:
    """kind (``file`` or ``folder``), path, depth, modificationTime, length of a tree, listed by tasks.

    ``folder`` rows are the folders that were opened (``length`` is their number of files).  ``days``
    are ``yyyy/mm/dd`` texts (a part may be a glob) and ``hours`` numbers: folders outside them are
    never opened.  Names starting with ``.`` or ``_`` are left out, as in Spark's scans.  The result is
    read from tables written in the shared folder; a lost executor repeats only its own folders.
    """
    ensure_shipped(spark)
    if isinstance(days, str):
        days = [days]
    days = None if days is None else [d.strip("/") for d in days]
    if hours is not None:
        days = days or ["*/*/*"]
        hours = {f"{int(h):02d}" for h in hours}
    if modified_after is not None:
        import datetime as dt

        when = dt.datetime.fromisoformat(str(modified_after))
        when = when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)
        modified_after = (when - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    base = spelled(base.rstrip("/") or "/")
    run = partial(_walk, base=base, days=days, hours=hours, glob=glob, contains=contains, after=modified_after,
                  max_depth=max_depth)
    target = new_scratch(spark, "listing")
    frontier, left, rounds = spark.createDataFrame([(base, 0)], "path string, depth int").coalesce(1), 1, []
    while left:
        rounds.append(f"{target}/round={len(rounds)}")
        # the number of folders left is all the driver learns of the tree
        left = write_observed(frontier.mapInArrow(run, WALK_SCHEMA), rounds[-1],
                              F.count_if(F.col("kind") == "left").alias("left"))["left"]
        found = spark.read.schema(WALK_SCHEMA).parquet(rounds[-1]).where("kind = 'left'").select("path", "depth")
        frontier = found.repartition(min(left, shuffle_partitions(spark)) or 1, "path")
    return spark.read.schema(WALK_SCHEMA).parquet(*rounds).where("kind <> 'left'")


def list_tree(spark: SparkSession, base: str, days=None, hours=None, glob: str | None = None, contains: str | None = None,
              modified_after=None, max_depth: int | None = None) -> DataFrame:
    """path, modificationTime, length of the files below ``base``: ``walk_tree`` without its folders.

    For trees of any size; ``list_files`` plans one file scan instead, whose index is on the driver
    and which leaves out files of no bytes."""
    return walk_tree(spark, base, days, hours, glob, contains, modified_after, max_depth) \
        .where("kind = 'file'").select("path", "modificationTime", "length")


# ---- read plans balanced by bytes ---------------------------------------------------------

def running_sums(df: DataFrame, key: str, sums: dict[str, Column], rows: int, cell_rows: int = CELL_FILES) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows before each row (in a fixed order of hashed keys).

    Rows are dealt to cells of about ``cell_rows`` by a hash of ``key``; sums run inside a cell and
    start from the totals of the cells before it, so no task orders more than a cell.
    """
    n_cells = max(1, -(-rows // cell_rows))
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(n_cells)) if n_cells > 1 else F.lit(0).cast("long")
    data = df.withColumns({"_cell": cell, **{f"_w_{a}": c for a, c in sums.items()}})
    inside = Window.partitionBy("_cell").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    data = data.withColumns({a: F.coalesce(F.sum(f"_w_{a}").over(inside), F.lit(0)) for a in sums})
    if n_cells > 1:
        totals = df.withColumn("_c", cell).groupBy("_c").agg(*[F.sum(c).alias(f"_t_{a}") for a, c in sums.items()])
        before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)          # a row per cell
        totals = totals.select("_c", *[F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_b_{a}") for a in sums])
        data = data.join(totals, F.col("_cell") == F.col("_c"))
        data = data.withColumns({a: F.col(a) + F.col(f"_b_{a}") for a in sums})
    return data.select(*df.columns, *sums)


def balanced(files: DataFrame, path_col: str = "path", length_col: str = "length", target_bytes: int = TARGET_BYTES,
             file_cost: int = FILE_COST, min_partitions: int = 1) -> DataFrame:
    """``files`` dealt to partitions of equal bytes, with the partition's number in ``_bin``.

    Each partition is a range of the running sum of lengths (``file_cost`` is added to each), so it
    holds at most ``target_bytes`` and the file that crosses its end; a file of ``target_bytes`` or
    more has a partition of its own.  Only a count and two sums reach the driver.  With fewer bytes
    the target shrinks until there are ``min_partitions``; beyond ``MAX_PARTITIONS`` it grows.
    Rows with a NULL length count as empty files.
    """
    weight = F.coalesce(F.col(length_col), F.lit(0)) + F.lit(file_cost)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"),
                      F.max(weight).alias("most")).first()
    n, size = int(total["n"]), int(total["bytes"])
    if n == 0:
        return files.withColumn("_bin", F.lit(0)).limit(0)
    bins = max(min(max(-(-size // target_bytes), min_partitions), MAX_PARTITIONS, n), 1)
    target = -(-size // bins)
    large = weight >= target
    n_large = files.where(large).count() if total["most"] >= target else 0
    placed = running_sums(files, path_col, {"_before": F.when(large, 0).otherwise(weight),
                                            "_large": F.when(large, 1).otherwise(0)}, n)
    placed = placed.withColumn("_bin", F.when(large, F.lit(bins) + F.col("_large"))
                               .otherwise(F.floor(F.col("_before") / F.lit(target))).cast("int"))
    return placed.drop("_before", "_large").repartitionById(bins + n_large, F.col("_bin"))

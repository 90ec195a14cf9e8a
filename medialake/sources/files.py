"""Real files: listing folders level by level, and bounded reads of their ends and headers."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .scratch import Kept

LISTED = "root string, path string, size_bytes long, modified_s long, entry_type string, error string"
NAMES = ["root", "path", "size_bytes", "modified_s", "entry_type", "error"]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
#: Rows of an Arrow batch.
ROWS = 5000
#: Folders that a task walks, where there are more than tasks.
FOLDERS = 500
#: The most that the scan reads of a file, by what it reads it for.
COSTS = {"discover": 2 << 20, "enrich": 1 << 20, "header": 64}


def entries(root: str, folder: str) -> Iterator[tuple]:
    """What lies directly in a folder, as it is read: names that start with a dot are skipped, links never followed; what can't be read is a row with an error."""
    try:
        found = os.scandir(folder)
    except OSError as e:
        yield root, folder, None, None, "error", str(e)
        return
    with found:
        while True:
            try:
                e = next(found, None)
            except OSError as error:
                yield root, folder, None, None, "error", str(error)
                return
            if e is None:
                return
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                yield root, e.path, None, None, "directory", None
                continue
            try:
                stat = e.stat(follow_symlinks=False)
                yield root, e.path, stat.st_size, int(stat.st_mtime), "file", None
            except OSError as error:
                yield root, e.path, None, None, "error", str(error)


def batches(rows: Iterator[tuple], size: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], names=NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], names=NAMES)


def list_inventory(roots: DataFrame, recurse: bool = True, kept: Kept | None = None) -> DataFrame:
    """Files below roots(root), a row each; names that start with a dot are skipped, links never followed, and a folder that can't be read is a row with an error.

    Folders are walked level by level: the folders that a level finds are a table, dealt anew over all tasks for the next, so a root with one folder of many folders keeps every task busy,
    and no task walks a tree. As many jobs as the tree is deep. Every executor must see the folders.
    """
    kept = kept or Kept(roots.sparkSession, "inventory")

    def walk(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from batches(entries(root, path))

    levels, frontier, tasks = [], roots.select("root", F.col("root").alias("path")).distinct(), roots.sparkSession.sparkContext.defaultParallelism
    while True:
        n = frontier.count()  # paths are few bytes, but slow to walk: their number is what is dealt, and stays as it is asked for
        level = kept.save(frontier.repartition(max(1, min(n, max(tasks, n // FOLDERS))), "path").mapInArrow(walk, LISTED), f"level-{len(levels)}")
        levels.append(level.where("entry_type <> 'directory'"))
        frontier = level.where("entry_type = 'directory'").select("root", "path")
        if not recurse or frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


class Span(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class InventorySource(DataSource):
    """spark.read.format("inventory").option("paths", "/a\\n/b").load(): what lies directly in the folders, planned as partitions of a few folders; folders that can't be read are rows with an error.

    Options: paths, by line ends; partitions (8). For trees use list_inventory.
    """

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return InventoryReader([p for p in self.options.get("paths", "").split("\n") if p], int(self.options.get("partitions", "8")))


class InventoryReader(DataSourceReader):
    def __init__(self, folders: list[str], partitions: int):
        self.folders, self.n = folders, max(1, min(partitions, len(folders)))

    def partitions(self) -> list[InputPartition]:
        return [Span(self.folders[i :: self.n]) for i in range(self.n)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for folder in partition.folders:
            yield from batches(entries(folder, folder))


Opened = Callable[[str], tuple[pafs.FileSystem, str]]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. A path without a scheme is of this machine."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_span(file, start: int, size: int, chunk: int) -> Iterator[bytes]:
    """The bytes from start on, size at most, in reads of `chunk` at most."""
    file.seek(start)
    while size > 0 and (data := file.read(min(chunk, size))):
        yield data
        size -= len(data)


def state_of(fs: pafs.FileSystem, path: str) -> tuple[int, int | None]:
    """Size and second of a file; raises where there is none."""
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(f"{path} is no file")
    return info.size, None if info.mtime_ns is None else info.mtime_ns // 10**9


def identity_of(path: str, size: int, modified: int, span: int, chunk: int, opened: Opened = file_system) -> tuple[str, str | None, str | None]:
    """path, sampled identity, error of one file, by two seeks. A file whose size or second isn't the listed one, before or after, has an error and no value."""
    try:
        fs, at = opened(path)
        if state_of(fs, at) != (size, modified):
            return path, None, "changed since it was listed"
        digest = hashlib.sha256()
        with fs.open_input_file(at) as file:
            for start, length in [(0, size)] if size <= 2 * span else [(0, span), (size - span, span)]:
                for data in read_span(file, start, length, chunk):
                    digest.update(data)
        digest.update(size.to_bytes(8, "little"))
        if state_of(fs, at) != (size, modified):
            return path, None, "changed while it was read"
        return path, digest.hexdigest(), None
    except (OSError, pa.ArrowException) as e:
        return path, None, str(e)


def dealt_by_cost(files: DataFrame, stage: str, bytes_per_task: int = 256 << 20, most_tasks: int = 100_000) -> DataFrame:
    """files(path, size_bytes, ...) over as many tasks as the reads of the stage need: a file costs what is read of it, COSTS at most, and something for being opened."""
    cost = F.least(F.coalesce("size_bytes", F.lit(0)), F.lit(COSTS[stage])) + 64 * 1024
    total = files.agg(F.sum(cost)).first()[0] or 0
    n = max(1, min(most_tasks, -(-total // bytes_per_task)))
    return files.repartition(max(n, files.sparkSession.sparkContext.defaultParallelism) if total > bytes_per_task else n, "path")


def hash_files(files: DataFrame, span: int = 1 << 20, chunk: int = 256 << 10, opened: Opened = file_system) -> DataFrame:
    """path, value, error of files(path, size_bytes, modified_s): the sampled identity, by two seeks and reads of `chunk` bytes at most, on any file system that pyarrow opens.

    Files are dealt by what reading them costs. A file whose size or time isn't the listed one, before or after, or that can't be read, gives an error and no value.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [identity_of(p, s, m, span, chunk, opened) for p, s, m in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["path", "value", "error"])

    return dealt_by_cost(files.select("path", "size_bytes", "modified_s"), "discover").mapInArrow(run, "path string, value string, error string")


def header_of(path: str, size: int, opened: Opened = file_system) -> tuple[str, bytes | None, str | None]:
    try:
        fs, at = opened(path)
        with fs.open_input_file(at) as file:
            return path, b"".join(read_span(file, 0, size, size)), None
    except (OSError, pa.ArrowException) as e:
        return path, None, str(e)


def read_ranges(files: DataFrame, size: int = 64, opened: Opened = file_system) -> DataFrame:
    """path, header, error of files(path): their first bytes alone, however large they are."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [header_of(p, size, opened) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.binary(), pa.string()))], names=["path", "header", "error"])

    return dealt_by_cost(files.select("path", F.lit(size).cast("long").alias("size_bytes")), "header").mapInArrow(run, "path string, header binary, error string")


def read_headers(spark: SparkSession, paths: list[str], size: int = 64) -> DataFrame:
    """path, header of a few named files."""
    return read_ranges(spark.createDataFrame([(p,) for p in paths], "path string"), size).select("path", "header")

"""Listings and bounded reads of real files."""

import hashlib
import os

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from medialake.sources import files


def test_a_single_top_folder_keeps_all_tasks_busy(spark, tmp_path):
    """One folder of 300 folders, each with a file, a deep one, a link back up and one that can't be read."""
    top = tmp_path / "top"
    for i in range(300):
        (top / f"d{i}").mkdir(parents=True)
        (top / f"d{i}" / "a.mp3").write_bytes(b"x" * i)
    (top / "d0" / "e" / "f").mkdir(parents=True)
    (top / "d0" / "e" / "f" / "_deep.mp3").write_bytes(b"")
    (top / "d1" / "back").symlink_to(top)
    (top / "d2" / ".dot").mkdir()
    roots = spark.createDataFrame([(str(tmp_path),), (str(tmp_path / "none"),)], "root string")
    rows = files.list_inventory(roots).collect()
    found = {r.path.removeprefix(f"{top}/"): r.size_bytes for r in rows if r.entry_type == "file"}
    assert found == {f"d{i}/a.mp3": i for i in range(300)} | {"d0/e/f/_deep.mp3": 0}
    assert [(r.root, r.entry_type) for r in rows if r.error] == [(str(tmp_path / "none"), "error")]
    tasks = files.list_inventory(roots).where("entry_type = 'file'").groupBy(F.input_file_name()).count().collect()
    assert len([t for t in tasks if t["count"] > 20]) >= 3  # the level of 300 folders was walked by several tasks
    assert {r.path for r in files.list_inventory(roots, recurse=False).collect()} == {str(tmp_path / "none")}


def test_inventory_as_a_data_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.mp3").write_bytes(b"abc")
    (tmp_path / "b").mkdir()
    spark.dataSource.register(files.InventorySource)
    df = spark.read.format("inventory").option("paths", f"{tmp_path}/a\n{tmp_path}/b\n{tmp_path}/none\n{tmp_path}").load()
    got = {(os.path.basename(r.path), r.entry_type) for r in df.collect()}
    assert got == {("x.mp3", "file"), ("none", "error"), ("a", "directory"), ("b", "directory")}


class Counting(pafs.FileSystemHandler):
    """The local file system as another one, which counts what is read."""

    def __init__(self):
        self.real, self.bytes, self.opens = pafs.LocalFileSystem(), 0, 0

    def get_type_name(self):
        return "counting"

    def get_file_info(self, paths):
        return self.real.get_file_info(paths)

    def open_input_file(self, path):
        import pyarrow as pa

        self.opens += 1
        file, me = open(path, "rb"), self

        class Watched:
            closed = False
            read = lambda _, n=-1: me.took(file.read(n))
            seek = lambda _, *a: file.seek(*a)
            tell = lambda _: file.tell()
            close = lambda _: file.close()
            readable = seekable = lambda _: True
            writable = lambda _: False

        return pa.PythonFile(Watched(), mode="r")

    def took(self, data):
        self.bytes += len(data)
        return data

    def __getattr__(self, name):
        raise NotImplementedError(name)


for name in [n for n in dir(pafs.FileSystemHandler) if not n.startswith("__") and n not in ("get_type_name", "get_file_info", "open_input_file")]:
    setattr(Counting, name, lambda self, *a, **k: NotImplemented)
Counting.__abstractmethods__ = frozenset()


def test_bounded_reads_of_a_file_beyond_2_gb(spark, tmp_path):
    """Both ends and the header of a sparse file of 3 GB, on a file system of another type: few bytes are read."""
    path, size = str(tmp_path / "large.mkv"), 3 << 30
    with open(path, "wb") as f:
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    modified, span = int(os.stat(path).st_mtime), 1 << 20
    want = hashlib.sha256(b"head" + bytes(span - 4) + bytes(span - 4) + b"tail" + size.to_bytes(8, "little")).hexdigest()
    handler = Counting()
    other = lambda p: (pafs.PyFileSystem(handler), p)
    assert files.identity_of(path, size, modified, span, 256 << 10, other) == (path, want, None)
    assert handler.opens == 1 and handler.bytes == 2 * span
    assert files.header_of(path, 64, other) == (path, b"head" + bytes(60), None) and handler.bytes == 2 * span + 64
    assert files.identity_of(path, size, modified + 1, span, 256 << 10, other)[2] == "changed since it was listed"
    rows = spark.createDataFrame([(path, size, modified), (f"file://{path}", size, modified), (str(tmp_path / "none"), 1, 1)], "path string, size_bytes long, modified_s long")
    got = {r.path: r for r in files.hash_files(rows).collect()}
    assert got[path].value == got[f"file://{path}"].value == want and "no file" in got[str(tmp_path / "none")].error
    heads = {r.path: r for r in files.read_ranges(rows).collect()}
    assert bytes(heads[path].header) == b"head" + bytes(60) and heads[str(tmp_path / "none")].error


def test_files_are_dealt_by_what_is_read_of_them(spark):
    rows = spark.range(4000).select(F.concat(F.lit("/f"), "id").alias("path"), F.lit(1 << 40).alias("size_bytes"))
    assert files.dealt_by_cost(rows, "discover", 256 << 20).rdd.getNumPartitions() == -(-4000 * ((2 << 20) + 65536) // (256 << 20))
    assert files.dealt_by_cost(rows, "header", 256 << 20).rdd.getNumPartitions() == 1

"""Scans over time: ids, retries and what is computed how often."""

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialake.operators import full_scan

LISTED = "path string, kind string, size_bytes long, modified_s long, content string"
FILES = "library_id int, file_id long, path string, kind string, size_bytes long, modified_s long, scanned_s long, missing_s long"
PENDING = "library_id int, path string, size_bytes long, modified_ms long, stage string, file_id long"


class History:
    """Runs scans of one library one after another, each from what the one before left."""

    def __init__(self, spark, kind="music"):
        self.spark = spark
        self.roots = spark.createDataFrame([(1, "/m")], "library_id int, root string")
        self.libraries = spark.createDataFrame([(1, kind)], "library_id int, type string")
        self.files, self.hashes = spark.createDataFrame([], FILES), spark.createDataFrame([], "file_id long, kind string, value string")
        self.items, self.pending, self.now = spark.createDataFrame([], "file_id long"), spark.createDataFrame([], PENDING), 100

    def scan(self, rows, failing=(), hashed=None, **more):
        self.now += 1
        value = F.when(~F.col("path").isin(*failing, "-"), F.md5("content"))
        hooks = full_scan.Hooks(hash_of=hashed or (lambda read: read.select("library_id", "path", value.alias("value"))))
        got = full_scan.scan(self.spark.createDataFrame(rows, LISTED), self.roots, self.files, self.hashes, self.items, self.pending, F.lit(self.now).cast("long"), hooks, libraries=self.libraries, **more)
        self.files, self.hashes, self.items, self.pending = (got.tables.save(x, n) for x, n in ((got.files, "f"), (got.hashes, "h"), (got.items, "i"), (got.pending, "p")))
        return got

    def by_path(self):
        return {r.path: r for r in self.files.collect()}


def test_a_path_that_is_used_again_is_a_new_file(spark):
    """/m/a moves to /m/b; a new file comes to /m/a: two files, two ids, two hashes."""
    h = History(spark)
    h.scan([("/m/a", "audio", 5, 9, "one")])
    first = h.by_path()["/m/a"].file_id
    moved = h.scan([("/m/b", "audio", 5, 9, "one")])
    assert [(r.path, r.file_id, r.old_path) for r in moved.moves.collect()] == [("/m/b", first, "/m/a")]
    h.scan([("/m/b", "audio", 5, 9, "one"), ("/m/a", "audio", 7, 20, "two")])
    rows = h.by_path()
    assert rows["/m/b"].file_id == first and rows["/m/a"].file_id == first + 1
    assert Counter(r.file_id for r in h.hashes.collect()) == {first: 1, first + 1: 1}
    assert sorted(r.file_id for r in h.items.collect()) == [first, first + 1]


def test_a_file_whose_hash_failed_is_read_again(spark):
    h = History(spark)
    h.scan([("/m/a", "audio", 5, 9, "one")])
    got = h.scan([("/m/a", "audio", 6, 10, "two"), ("/m/n", "audio", 1, 1, "new")], failing=("/m/a", "/m/n"))
    assert {(r.path, r.size_bytes, r.scanned_s) for r in h.files.collect()} == {("/m/a", 5, 101)}  # neither stamped nor added
    assert {(r.path, r.stage, r.size_bytes) for r in h.pending.collect()} == {("/m/a", "discover", 6), ("/m/n", "discover", 1)}
    assert {r.path for r in got.errors.collect()} == {"/m/a", "/m/n"}
    assert got.tally.select("errors", "updated", "added").first() == (2, 0, 0)
    got = h.scan([("/m/a", "audio", 6, 10, "two"), ("/m/n", "audio", 1, 1, "new")])
    assert {(r.path, r.size_bytes, r.scanned_s) for r in h.files.collect()} == {("/m/a", 6, 103), ("/m/n", 1, 103)}
    assert {r.stage for r in h.pending.collect()} == {"metadata"} and got.errors.count() == 0


@pytest.mark.parametrize("kind, added", [("images", 1), ("music", 0)])
def test_pictures_are_items_of_image_libraries(spark, kind, added):
    h = History(spark, kind)
    got = h.scan([("/m/a.png", "image", 5, 9, "x")])
    assert got.tally.select("added", "skipped").first() == (added, 1 - added)
    again = h.scan([("/m/a.png", "image", 5, 9, "x")])
    assert again.tally.select("unchanged", "missing").first() == (added, 0)


def test_each_file_is_hashed_once(spark):
    """Whatever results are asked for, the hash hook sees a file once."""
    count = spark.sparkContext.accumulator(0)

    def hashed(read):
        def run(batches):
            for df in batches:
                count.add(len(df))
                yield pd.DataFrame({"library_id": df.library_id, "path": df.path, "value": df.content})

        return read.select("library_id", "path", "content").mapInPandas(run, "library_id int, path string, value string")

    h = History(spark)
    got = h.scan([("/m/a", "audio", 5, 9, "one"), ("/m/b", "audio", 5, 9, "two"), ("/m/c", "video", 5, 9, "one")], hashed=hashed)
    for result in (got.files, got.hashes, got.items, got.tags, got.events, got.tally, got.pending, got.errors):
        result.collect()
    assert count.value == 3


def test_unreadable_folders_and_removed_roots_miss_nothing(spark):
    h = History(spark)
    h.scan([("/m/a", "audio", 5, 9, "one"), ("/m/far/b", "audio", 5, 9, "two")])
    got = h.scan([("/m/a", "audio", 5, 9, "one")], errors=spark.createDataFrame([("/m/far", "permission denied")], "path string, error string"))
    assert got.tally.select("missing", "errors").first() == (0, 1) and h.by_path()["/m/far/b"].missing_s is None
    h.roots = spark.createDataFrame([(1, "/m/far")], "library_id int, root string")
    got = h.scan([("/m/far/b", "audio", 5, 9, "two")])
    assert got.tally.select("seen", "missing").first() == (1, 0) and h.by_path()["/m/a"].missing_s is None


def test_ties_in_places(spark):
    from medialake.operators.places import placed
    from medialake.sources.scratch import Kept

    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.lit(7).alias("k"), "id")
    got = placed(rows, ["g"], ["k"], Kept(spark, "places")).collect()
    for g in (None, 1, 2):
        mine = sorted(r.place for r in got if r.g == g)
        assert mine == list(range(len(mine))) and len(mine) in (333, 334)


def test_no_task_gets_all_files_below_a_root(spark):
    """Few roots, libraries and folders are broadcast, whatever the planner thinks of their size: a shuffle by them would give one task all files below one."""
    from medialake.operators import scan

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paths = spark.range(1000).select(F.concat(F.lit("/lib/a/"), F.col("id").cast("string")).alias("path"), F.lit(1).alias("library_id"))
        roots = spark.range(2000).select(F.lit(1).alias("library_id"), F.lit("/lib").alias("root")).distinct()
        folders = roots.select("library_id", F.lit("/lib/a").alias("dir"))
        for rows in (scan.under(paths.select("path"), roots), scan.in_directories(paths, folders)):
            assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)

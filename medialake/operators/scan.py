"""Incremental scans: which files of an inventory are new, changed, gone, moved or the same as the catalog knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import format_tag, sidecar_kind
from ..functions.paths import ancestors, dirname, hidden_below

#: Hashes that show a file has been read.
IDENTITIES = ("sampledSha256", "sha256")
#: Most rows of roots, libraries and folders that are sent to every executor.
SMALL = 100_000


def few(rows: DataFrame) -> DataFrame:
    """rows, sent to every executor where their counted number is small: all files lie below a few roots and in a few libraries, and a shuffle by these would give one task a whole library."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def under(paths: DataFrame, roots: DataFrame, root: str = "root", itself: bool = False) -> DataFrame:
    """Every path with every root that contains it: directories above the path are joined by equality, so no root is compared with every path.

    Columns: those of paths and of roots. itself: a path equal to a root counts too.
    """
    above = paths.withColumn("above", F.explode(ancestors(F.col("path"), itself)))
    return above.join(few(roots), F.col("above") == F.col(root)).drop("above")


def scope(inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """inventory(path, ...) below roots(library_id, root): each path once in each library, however its roots are nested."""
    return under(inventory, roots).drop("root").dropDuplicates(["library_id", "path"])


def safe_only(rows: DataFrame, unsafe: DataFrame) -> DataFrame:
    """rows whose path is neither one of unsafe(path) nor below one: what must not be called missing."""
    risky = under(rows.select("path"), unsafe.select(F.col("path").alias("unsafe")).distinct(), "unsafe", itself=True).select("path").distinct()
    return rows.join(risky, "path", "left_anti")


def in_directories(rows: DataFrame, directories: DataFrame) -> DataFrame:
    """rows that lie directly in directories(dir), or, where both name a library, directories(library_id, dir) of their library."""
    by = ["library_id"] if "library_id" in directories.columns and "library_id" in rows.columns else []
    return rows.withColumn("dir", dirname(F.col("path"))).join(few(directories.select(*by, "dir").distinct()), [*by, "dir"], "left_semi").select(*rows.columns)


def scan_targets(directories: DataFrame, roots: DataFrame) -> DataFrame:
    """directories(dir) that a root contains or is, with no part starting with a dot in between."""
    held = under(directories.withColumnRenamed("dir", "path"), roots.select("root").distinct(), itself=True)
    return held.where(~hidden_below(F.col("root"), F.col("path"))).select(F.col("path").alias("dir")).distinct()


def diff(known: DataFrame, inventory: DataFrame, hashes: DataFrame, pending: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, file_id, status (new, changed, unchanged, missing), pending_stage. With a library among the keys, one path may be in many libraries, each with a file of its own.

    A file is unchanged if it has been scanned, has an identity hash, is of the same size and second, and any pending work was for just this state.
    """
    read = hashes.where(F.col("kind").isin(*IDENTITIES)).select(F.col("file_id").alias("read_id")).distinct()
    old = known.select(*keys, "file_id", F.col("size_bytes").alias("old_size"), F.col("modified_s").alias("old_s"), "scanned_s", F.lit(True).alias("was"))
    old = old.join(read, F.col("file_id") == F.col("read_id"), "left")
    new = inventory.select(*keys, "size_bytes", "modified_s", F.lit(True).alias("there"))
    work = pending.select(*keys, F.col("size_bytes").alias("work_size"), "modified_ms", F.col("stage").alias("pending_stage"))
    both = new.join(old, list(keys), "full").join(work, list(keys), "left")
    same = F.col("scanned_s").isNotNull() & F.col("read_id").isNotNull() & (F.col("size_bytes") == F.col("old_size")) & (F.col("modified_s") == F.col("old_s"))
    done = F.col("pending_stage").isNull() | ((F.col("work_size") == F.col("size_bytes")) & (F.col("modified_ms") == F.col("modified_s") * 1000))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("was").isNull(), "new").when(same & done, "unchanged").otherwise("changed")
    return both.select(*keys, "file_id", status.alias("status"), "pending_stage")


def work_of(diffed: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, stage: new and changed files, and unchanged ones with discovery pending, are to be discovered; unchanged ones with metadata pending enriched."""
    stage = F.when(F.col("status").isin("new", "changed"), "discover").when(F.col("status") == "unchanged", F.col("pending_stage"))
    return diffed.select(*keys, stage.alias("stage")).where("stage IS NOT NULL")


def mark_missing(known: DataFrame, diffed: DataFrame, scan_s: Column, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """known with missing_s: stamped at the first scan that misses a file, cleared when the file is there again, changed or not; nothing is deleted."""
    stamp = F.when(F.col("status") == "missing", F.coalesce("missing_s", scan_s)).when(F.col("status").isNull(), F.col("missing_s"))
    return known.join(diffed.select(*keys, "status"), list(keys), "left").withColumn("missing_s", stamp).drop("status")


def recognise_moves(new: DataFrame, missing: DataFrame, listing: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by (a library), path, file_id, old_path of new(path, value) files whose hash is that of missing(file_id, path, value).

    A candidate whose own path is still in the raw listing(path) was copied, not moved. Of a hash's candidates the one of the highest id stands, of the
    new files the lowest path; each moves once. Hashes that no file is missing never leave the semi join, so no hot hash is ranked for nothing.
    """
    gone, same = missing.join(listing.select(*by, "path").distinct(), [*by, "path"], "left_anti"), [*by, "value"]
    last = gone.groupBy(*same).agg(F.max_by(F.struct("file_id", "path"), F.col("file_id")).alias("old"))
    first = new.join(gone.select(*same).distinct(), same, "left_semi").groupBy(*same).agg(F.min("path").alias("path"))
    return first.join(last, same).select(*by, "path", F.col("old.file_id").alias("file_id"), F.col("old.path").alias("old_path"))


def tally(diffed: DataFrame, moves: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a key (a library): seen, discovered, enriched, added, updated, moved, missing, unchanged. A moved file is neither added nor, at its old path, missing."""
    keys = keys or []
    at = [*keys, "path"]
    rows = diffed.join(moves.select(*at, F.lit(True).alias("moved_in")), at, "left").join(moves.select(*keys, F.col("old_path").alias("path"), F.lit(True).alias("moved_out")), at, "left")
    n = lambda c: F.count_if(c).alias
    fresh = F.col("status").isin("new", "changed")
    return rows.groupBy(*keys).agg(
        n(F.col("status") != "missing")("seen"), n(fresh | ((F.col("status") == "unchanged") & (F.col("pending_stage") == "discover")))("discovered"), n((F.col("status") == "unchanged") & (F.col("pending_stage") == "metadata"))("enriched"),
        n((F.col("status") == "new") & F.col("moved_in").isNull())("added"), n(F.col("status") == "changed")("updated"), n(F.col("moved_in").isNotNull())("moved"),
        n((F.col("status") == "missing") & F.col("moved_out").isNull())("missing"), n(F.col("status") == "unchanged")("unchanged"),
    )


def side_tally(inventory: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: sidecars, artwork, skipped of inventory(keys, path, kind), and errors of errors(keys): files beside the items, and what went wrong, all counted."""
    side = sidecar_kind(F.col("path"))
    picture = F.col("kind").eqNullSafe("image")
    none = F.lit(0).cast("long")
    rows = inventory.select(*keys, (side.isNotNull() & ~picture).cast("long").alias("sidecars"), picture.cast("long").alias("artwork"), (F.col("kind").isNull() & side.isNull()).cast("long").alias("skipped"), none.alias("errors"))
    rows = rows.unionByName(errors.select(*keys, none.alias("sidecars"), none.alias("artwork"), none.alias("skipped"), F.lit(1).cast("long").alias("errors")))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sidecars", "artwork", "skipped", "errors")])


def revalidate(known: DataFrame, roots: DataFrame) -> DataFrame:
    """known with scanned_s nulled below each of roots(root, source_id, last_source_id) whose source is unknown or another."""
    odd = roots.where("last_source_id IS NULL OR NOT source_id <=> last_source_id").select("root").distinct()
    hit = under(known.select("path"), odd).select("path", F.lit(True).alias("hit")).distinct()
    return known.join(hit, "path", "left").withColumn("scanned_s", F.when(F.col("hit").isNull(), F.col("scanned_s"))).drop("hit")


def availability(paths: DataFrame, roots: DataFrame, default: bool = True) -> DataFrame:
    """path, available: whether every one of roots(root, available) that contains it is; `default` where none does."""
    held = under(paths.select("path"), roots).groupBy("path").agg(F.bool_and("available").alias("all_there"))
    return paths.select("path").distinct().join(held, "path", "left").select("path", F.coalesce("all_there", F.lit(default)).alias("available"))


def lacking_items(diffed: DataFrame, items: DataFrame) -> DataFrame:
    """file_id of unchanged files that have no item yet."""
    return diffed.where("status = 'unchanged'").select("file_id").join(items.select("file_id"), "file_id", "left_anti")


def membership(diffed: DataFrame, files: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items(file_id) that unchanged files lack, and their tags(item_id, namespace, name): the format that the ending of files(file_id, path, kind) says, and the kind."""
    new = lacking_items(diffed, items)
    rows = new.join(files.select("file_id", "path", "kind"), "file_id")
    tags = F.array(F.struct(F.lit("format").alias("namespace"), format_tag(F.col("path")).alias("name")), F.struct(F.lit("kind").alias("namespace"), F.col("kind").alias("name")))
    return new, rows.select(F.col("file_id").alias("item_id"), F.inline(tags)).where("name IS NOT NULL AND name <> ''")


def stale_work(pending: DataFrame, inventory: DataFrame, unsafe: DataFrame | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Pending work whose file is not listed any more, but for what lies below unsafe(path): that may be there."""
    gone = pending.join(inventory.select(*keys), list(keys), "left_anti")
    return gone if unsafe is None else safe_only(gone, unsafe)


def first_errors(errors: DataFrame, by: str, order: list[str], most: int = 50) -> DataFrame:
    """The first errors of each library, in the order they came up."""
    return errors.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= most)


def changed_fields(old: Column, new: Column) -> Column:
    """Of two JSON objects: the fields whose values differ, with the new value, null where it is gone."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = read(old), read(new)
    keys = F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.try_element_at(b, k))))


def slices(rows: DataFrame, order: str, n: int, sample: int = 20_000) -> Column:
    """Which of about n ranges of a text column, cut at sampled values, a row is in. The cuts change no result, only how rows are dealt."""
    share = min(1.0, sample / max(1, rows.count()))
    seen = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).sample(share, 7).limit(2 * sample).collect())
    cuts = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: c <= F.col(order)))


def reads_upto(files: DataFrame, stage: str, order: str = "path") -> DataFrame:
    """files(size_bytes, ...) with cost and upto, the costs' running sum in this order: discovery reads at most 2 MiB of a file, enrichment 1 MiB.

    Running sums are kept within ranges of the order, then shifted by the ranges before, so no task sorts all files.
    """
    most = {"discover": 2 << 20, "enrich": 1 << 20}[stage]
    n = max(64, min(512, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = files.withColumn("cost", F.least("size_bytes", F.lit(most)).cast("long")).withColumn("slice", slices(files, order, n))
    sums = rows.groupBy("slice").agg(F.sum("cost").alias("total"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    sums = sums.select("slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), "slice").withColumn("upto", F.col("base") + F.sum("cost").over(inside)).drop("slice", "base")


def waves(files: DataFrame, stage: str, bytes_per_wave: int, order: str = "path") -> DataFrame:
    """files(size_bytes, ...) with cost and wave: a wave reads about bytes_per_wave, in this order."""
    return reads_upto(files, stage, order).withColumn("wave", F.floor((F.col("upto") - F.col("cost")) / bytes_per_wave)).drop("upto")

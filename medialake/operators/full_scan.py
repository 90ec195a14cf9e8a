"""One incremental scan, end to end: list, compare, hash, recognise moves, extract, add items, associate sidecars, keep the journal, tell what changed.

What several results need (the comparison, the hashes, the moves, the ids of new files, the metadata) is computed once and written to the shared folder; results are plans
over these tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import sidecar_kind
from ..functions.paths import dirname
from ..sources.scratch import Kept
from .changes import field_events, phase_events
from .merge import distinct_artwork, merge_tiers
from .places import placed
from .scan import diff, few, in_directories, membership, recognise_moves, safe_only, scan_targets, scope, stale_work, under
from .sidecars import associate, dirty_directories

#: A file is one of a library: the same path may be in several.
KEYS = ("library_id", "path")
COUNTS = ("seen", "discovered", "enriched", "added", "updated", "moved", "missing", "unchanged", "sidecars", "artwork", "skipped", "errors")


@dataclass
class Hooks:
    """What a user may put in the place of the library's own: how a file is identified, which sidecars belong to it, what reads its metadata, and who is told.

    hash_of: files(library_id, path, ...) -> library_id, path, value, and error where there is no value. associate: (files, others) -> library_id, media_path, sidecar_path, kind.
    extract: files(library_id, path, file_id, kind, ...) -> file_id, tier, columns of metadata, and, if it likes, artwork(role, mime, data); a file of which it says nothing has failed.
    observe: called with the result after it is written; what it raises is noted and changes nothing.
    """

    hash_of: Callable[[DataFrame], DataFrame] | None = None
    associate: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    extract: Callable[[DataFrame], DataFrame] | None = None
    observe: list[Callable[[Scanned], None]] = field(default_factory=list)


@dataclass
class Scanned:
    """The catalog after the scan, and what it did. `tables` are what the results are made of: remove them when the results are written."""

    diffed: DataFrame
    moves: DataFrame
    files: DataFrame
    hashes: DataFrame
    items: DataFrame
    tags: DataFrame
    pending: DataFrame
    sidecars: DataFrame
    metadata: DataFrame
    artwork: DataFrame
    events: DataFrame
    errors: DataFrame
    tally: DataFrame
    tables: Kept
    failures: list[str] = field(default_factory=list)


def within(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(library_id, path) that lie below a root of their library."""
    inside = under(rows.select(*KEYS), roots.select(F.col("library_id").alias("of"), "root")).where("library_id = of").select(*KEYS).distinct()
    return rows.join(inside, list(KEYS), "left_semi")


def scan(
    listing: DataFrame, roots: DataFrame, files: DataFrame, hashes: DataFrame, items: DataFrame, pending: DataFrame, now_s: Column, hooks: Hooks, *,
    libraries: DataFrame | None = None, directories: DataFrame | None = None, unsafe: DataFrame | None = None, errors: DataFrame | None = None, sidecars: DataFrame | None = None, file_id: Column | None = None,
) -> Scanned:
    """listing(path, kind, size_bytes, modified_s, ...) against files(library_id, file_id, path, kind, size_bytes, modified_s, scanned_s, missing_s, maybe metadata), hashes(file_id, kind, value),
    items(file_id), the journal pending(library_id, path, size_bytes, modified_ms, stage, maybe file_id) and sidecars(library_id, file_id, sidecar_path, kind, modified_s), for all libraries of roots at once.

    libraries(library_id, type): pictures are items in libraries of type images, and lie beside the items in others. directories(dir, maybe library_id): only what lies directly in these, if they
    can be scanned, is looked at, on both sides. unsafe(path), and the paths of errors(path, error) of the listing: nothing at or below them is called missing.

    New files get whole numbers above all that were ever given, so a path that is used again never takes over a file that left it (or file_id, an expression over the listing, of which the
    caller knows that it gives no number twice). Only a file whose hash was read is stamped: one whose
    hash failed stays as it was, in the journal, with an error, and is read again by the next scan. A moved file keeps its id, item, tags and metadata; a returned one is no longer missing;
    nothing is deleted. Work is journaled as `discover` until a file is hashed and as `metadata` until it is read; what isn't listed any more leaves the journal.
    """
    kept, on = Kept(files.sparkSession, "scan"), list(KEYS)
    listed, known = scope(listing, roots.select("library_id", "root")), within(files, roots)
    if directories is not None:
        targets = directories.join(scan_targets(directories.select("dir"), roots), "dir", "left_semi")
        listed, known = in_directories(listed, targets), in_directories(known, directories)
    if libraries is not None:
        listed = listed.join(few(libraries.select("library_id", (F.col("type") == "images").alias("pictures"))), "library_id", "left")
    item = F.col("kind").isNotNull() & ((F.col("kind") != "image") | (F.coalesce("pictures", F.lit(False)) if libraries is not None else F.lit(False)))
    listed = kept.save(listed.withColumn("is_item", item), "listed")
    media, others = listed.where("is_item"), listed.where("NOT is_item")

    odd = [x.select("path") for x in (unsafe, errors) if x is not None]
    odd = reduce(DataFrame.unionByName, odd) if odd else None
    diffed = diff(known, media, hashes, pending, KEYS)
    if odd is not None:
        lost = diffed.where("status = 'missing'")
        diffed = diffed.where("status <> 'missing'").unionByName(safe_only(lost, odd).select(*diffed.columns))
    diffed = kept.save(diffed, "diffed")

    jobs = diffed.where("status IN ('new', 'changed') OR (status = 'unchanged' AND pending_stage = 'discover')")
    read = media.join(jobs.select(*KEYS), on, "left_semi")
    values = hooks.hash_of(read) if hooks.hash_of else read.select(*KEYS, F.lit(None).cast("string").alias("value"))
    failed = F.col("error").cast("string") if "error" in values.columns else F.lit(None).cast("string")
    values = kept.save(values.select(*KEYS, F.col("value").cast("string").alias("value"), failed.alias("error")), "values")
    good = values.where("value IS NOT NULL").drop("error")
    fresh = good.join(diffed.where("status = 'new'").select(*KEYS), on, "left_semi")
    sampled = hashes.where("kind = 'sampledSha256'").select("file_id", "value")
    gone = diffed.where("status = 'missing'").select(*KEYS, "file_id")
    moves = kept.save(recognise_moves(fresh, gone.join(sampled, "file_id"), listed.select(*KEYS), ("library_id",)), "moves")

    last = files.agg(F.max("file_id")).first()[0]  # files are never deleted, so no number comes again
    added = fresh.join(moves.select(*KEYS), on, "left_anti").select(*KEYS)
    added = placed(added, [], on, kept, "place").select(*KEYS, (F.col("place") + F.lit((last if last is not None else 0) + 1)).alias("file_id")) if file_id is None else media.join(added, on, "left_semi").select(*KEYS, file_id.alias("file_id"))
    again = good.join(diffed.where("status <> 'new'").select(*KEYS, "file_id"), on)
    way = lambda rows, said: rows.select(*KEYS, F.col("file_id").cast("long").alias("file_id"), F.lit(said).alias("way"))
    ids = way(added, "added").unionByName(way(moves, "moved")).unionByName(way(again, "updated"))
    state = media.select(*KEYS, F.col("kind").alias("kind_now"), F.col("size_bytes").alias("size_now"), F.col("modified_s").alias("modified_now"))
    done = kept.save(ids.join(state, on).join(good, on), "discovered")  # every file that was hashed, under its id

    waiting = diffed.where("status = 'unchanged' AND pending_stage = 'metadata'").select(*KEYS, "file_id")
    work = kept.save(done.select(*KEYS, "file_id").unionByName(waiting.select(*KEYS, F.col("file_id").cast("long").alias("file_id"))), "to-enrich")
    told, fields = None, []
    if hooks.extract:
        said = hooks.extract(work.join(media.drop("is_item", "pictures"), on))
        told = kept.save(said if "tier" in said.columns else said.withColumn("tier", F.lit(0)), "told")
        fields = [c for c in told.columns if c not in ("file_id", "tier", "artwork")]
    metadata, artwork = extracted(told, work, fields, files, kept)
    enriched = kept.save(work.join(metadata.select("file_id"), "file_id", "left_semi").select(*work.columns), "enriched")

    after = stamped(files, diffed, done, moves, added, state, metadata, now_s)
    rehashed = done.select("file_id", F.lit("sampledSha256").alias("kind"), "value")
    hashed = hashes.join(rehashed.select("file_id"), "file_id", "left_anti").unionByName(rehashed)
    there = done.select(*KEYS, "file_id").unionByName(diffed.where("status = 'unchanged'").join(done.select(*KEYS), on, "left_anti").select(*KEYS, F.col("file_id").cast("long").alias("file_id")))
    present = kept.save(there.join(state.select(*KEYS, F.col("kind_now").alias("kind")), on), "present")
    more, tags = membership(present.select("file_id", F.lit("unchanged").alias("status")), present, items)
    more = kept.save(more, "items")
    all_items = items.unionByName(more, allowMissingColumns=True)

    beside, asserted, claimed = sides(media, others, jobs, present, sidecars, directories, hooks, kept)
    troubles = values.where("value IS NULL").select(*KEYS, F.coalesce("error", F.lit("not hashed")).alias("error"))
    if hooks.extract:
        troubles = troubles.unionByName(work.join(enriched.select("file_id"), "file_id", "left_anti").select(*KEYS, F.lit("no metadata").alias("error")))
    if errors is not None:
        troubles = troubles.unionByName(under(errors.select("path", "error"), roots.select("library_id", "root"), itself=True).select(*KEYS, "error").distinct())
    troubles = kept.save(troubles, "errors")

    events = events_of(roots, diffed, done, moves, more, present, enriched, metadata, artwork, files, jobs, waiting)
    counts = counted(roots, diffed, done, moves, enriched, artwork, asserted, claimed, others, troubles)
    return Scanned(diffed, moves, after, hashed, all_items, tags, journal(pending, diffed, media, jobs, done, enriched, directories, odd, roots), beside, metadata, artwork, events, troubles, counts, kept)


def extracted(told: DataFrame | None, work: DataFrame, fields: list[str], files: DataFrame, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """file_id, metadata (as JSON) of the files that extractors spoke of, merged over their tiers, and their distinct artwork(file_id, seq, role, mime, data)."""
    spark = files.sparkSession
    if told is None:
        return spark.createDataFrame([], "file_id long, metadata string"), spark.createDataFrame([], "file_id long, seq long, role string, mime string, data binary")
    heard = merge_tiers(told.select("file_id").distinct(), told.select("file_id", "tier", *fields))
    metadata = heard.select(F.col("file_id").cast("long").alias("file_id"), F.col("metadata").cast("string").alias("metadata") if fields == ["metadata"] else (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("metadata"))
    metadata = kept.save(metadata, "metadata")
    if "artwork" not in told.columns:
        return metadata, spark.createDataFrame([], "file_id long, seq long, role string, mime string, data binary")
    each = told.select(F.col("file_id").cast("long").alias("file_id"), "tier", F.posexplode("artwork").alias("seq", "art")).select("file_id", "tier", F.col("seq").cast("long").alias("seq"), "art.role", "art.mime", "art.data")
    return metadata, kept.save(distinct_artwork(each).drop("tier"), "artwork")


def stamped(files: DataFrame, diffed: DataFrame, done: DataFrame, moves: DataFrame, added: DataFrame, state: DataFrame, metadata: DataFrame, now_s: Column) -> DataFrame:
    """files as they are now: one join by id with what is known of each, then the added ones."""
    none = lambda t: F.lit(None).cast(t)
    hashed = done.where("way <> 'added'").select("library_id", "file_id", F.col("path").alias("path_now"), "kind_now", "size_now", "modified_now", F.lit(True).alias("read"), F.lit(True).alias("there"))
    left = diffed.where("file_id IS NOT NULL").select("library_id", F.col("file_id").cast("long").alias("file_id"), none("string").alias("path_now"), none("string").alias("kind_now"), none("long").alias("size_now"), none("long").alias("modified_now"), F.lit(False).alias("read"), (F.col("status") != "missing").alias("there"))
    seen = hashed.unionByName(left.join(hashed.select("library_id", "file_id"), ["library_id", "file_id"], "left_anti"))
    rows = files.join(seen, ["library_id", "file_id"], "left")
    now, read = now_s.cast(files.schema["scanned_s"].dataType), F.coalesce("read", F.lit(False))
    late = now_s.cast(files.schema["missing_s"].dataType)
    replaced = {
        "path": F.coalesce("path_now", "path"), "kind": F.when(read, F.col("kind_now")).otherwise(F.col("kind")), "size_bytes": F.when(read, F.col("size_now")).otherwise(F.col("size_bytes")),
        "modified_s": F.when(read, F.col("modified_now")).otherwise(F.col("modified_s")), "scanned_s": F.when(read, now).otherwise(F.col("scanned_s")),
        "missing_s": F.when(F.col("there").isNull(), F.col("missing_s")).when(~F.col("there"), F.coalesce("missing_s", late)),
    }
    rows = rows.select(*[(replaced[c] if c in replaced else F.col(c)).alias(c) for c in files.columns])
    new = added.join(state, list(KEYS)).select(*KEYS, "file_id", F.col("kind_now").alias("kind"), F.col("size_now").alias("size_bytes"), F.col("modified_now").alias("modified_s"), now.alias("scanned_s"), F.lit(None).cast(files.schema["missing_s"].dataType).alias("missing_s"))
    every = rows.unionByName(new, allowMissingColumns=True)
    if "metadata" not in files.columns:
        return every
    return every.join(metadata.select("file_id", F.col("metadata").alias("said")), "file_id", "left").withColumn("metadata", F.coalesce("said", "metadata")).select(*files.columns)


def journal(pending: DataFrame, diffed: DataFrame, media: DataFrame, jobs: DataFrame, done: DataFrame, enriched: DataFrame, directories: DataFrame | None, unsafe: DataFrame | None, roots: DataFrame) -> DataFrame:
    """library_id, path, size_bytes, modified_ms, stage, file_id of the work that is left."""
    on, ids = list(KEYS), F.col("file_id").cast("long").alias("file_id") if "file_id" in pending.columns else F.lit(None).cast("long").alias("file_id")
    columns = ["size_bytes", "modified_ms", "stage", "file_id"]
    old = pending.select(*KEYS, F.col("size_bytes").cast("long").alias("size_bytes"), F.col("modified_ms").cast("long").alias("modified_ms"), "stage", ids)
    mine = within(old, roots) if directories is None else in_directories(within(old, roots), directories)
    stale = stale_work(mine, media, unsafe, KEYS)
    old = old.join(stale.select(*KEYS), on, "left_anti").join(jobs.select(*KEYS), on, "left_anti").join(enriched.select(*KEYS), on, "left_anti")
    queued = media.join(jobs.select(*KEYS), on, "left_semi").join(enriched.select(*KEYS), on, "left_anti").join(done.select(*KEYS, "file_id"), on, "left")
    queued = queued.select(*KEYS, F.col("size_bytes").cast("long").alias("size_bytes"), (F.col("modified_s") * 1000).cast("long").alias("modified_ms"), F.when(F.col("file_id").isNull(), "discover").otherwise("metadata").alias("stage"), "file_id")
    return old.select(*KEYS, *columns).unionByName(queued.select(*KEYS, *columns))


def sides(media: DataFrame, others: DataFrame, jobs: DataFrame, present: DataFrame, known: DataFrame | None, directories: DataFrame | None, hooks: Hooks, kept: Kept) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sidecars after the scan, those asserted by it, and library_id, path of all files that some match claims.

    Files in directories with work, or with a sidecar that is new, of another second or gone, get what matches now; all others, missing ones too, keep what they had.
    """
    by, columns = ("library_id",), ["library_id", "file_id", "sidecar_path", "kind", "modified_s"]
    matches = hooks.associate(media, others) if hooks.associate else associate(media, others, by)
    if "media_path" not in matches.columns:  # a user's own shape: kept as it is
        own = others.where(sidecar_kind(F.col("path")).isNotNull()).select(*KEYS)
        return matches, own, own
    stamps = others.select("library_id", F.col("path").alias("sidecar_path"), F.col("modified_s").cast("long").alias("modified_s"))
    matches = kept.save(matches.select("library_id", "media_path", "sidecar_path", "kind").join(stamps, ["library_id", "sidecar_path"]), "matches")
    claimed = matches.select("library_id", F.col("sidecar_path").alias("path"), "modified_s").distinct()
    ids = present.select("library_id", F.col("path").alias("media_path"), "file_id")
    if known is None:
        asserted = matches.join(ids, ["library_id", "media_path"]).select(*columns)
        return asserted, asserted, claimed
    before = known.join(ids, ["library_id", "file_id"], "left_semi").select("library_id", F.col("sidecar_path").alias("path"), F.col("modified_s").cast("long").alias("modified_s")).distinct()
    every = media.select(*KEYS).unionByName(others.select(*KEYS)).select("library_id", dirname(F.col("path")).alias("dir"))
    only = every.where("false") if directories is None else every.distinct()  # all that is listed lies in these
    dirty = dirty_directories(jobs.select(*KEYS), only, before, claimed, by)
    anew = kept.save(ids.withColumn("dir", dirname(F.col("media_path"))).join(few(dirty), ["library_id", "dir"], "left_semi").drop("dir"), "anew")
    asserted = kept.save(matches.join(anew, ["library_id", "media_path"]).select(*columns), "asserted")
    return known.select(*columns).join(anew.select("library_id", "file_id"), ["library_id", "file_id"], "left_anti").unionByName(asserted), asserted, claimed


def events_of(roots, diffed, done, moves, more, present, enriched, metadata, artwork, files, jobs, waiting) -> DataFrame:
    """type, library_id, path, file_id, phase, fields of all that the scan did."""
    none = F.lit(None).cast("map<string,string>")
    row = lambda rows, kind, phase, fields=none: rows.select(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), "library_id", "path", F.col("file_id").cast("long").alias("file_id"), F.lit(phase).alias("phase"), fields.alias("fields"))
    libraries = roots.select("library_id").distinct()
    tasks = jobs.select("library_id", F.lit(1).alias("discover"), F.lit(0).alias("metadata")).unionByName(waiting.select("library_id", F.lit(0).alias("discover"), F.lit(1).alias("metadata")))
    tasks = libraries.join(tasks.groupBy("library_id").agg(F.sum("discover").alias("discover"), F.sum("metadata").alias("metadata")), "library_id", "left").fillna(0, ["discover", "metadata"])
    queued = tasks.withColumns({"path": F.lit(None).cast("string"), "file_id": F.lit(None).cast("long")})
    of = F.map_from_arrays(F.array(F.lit("discover"), F.lit("metadata")), F.array(F.col("discover").cast("string"), F.col("metadata").cast("string")))
    found = done.join(more.select(F.col("file_id").cast("long").alias("file_id"), F.lit(True).alias("is_new")), "file_id", "left")
    quiet = present.join(more.select("file_id"), "file_id", "left_semi").join(done.select("file_id"), "file_id", "left_anti")
    lost = diffed.where("status = 'missing'").join(moves.select("library_id", F.col("old_path").alias("path")), list(KEYS), "left_anti")
    said = enriched.select("library_id", "path", "file_id")
    parts = [
        phase_events(libraries), row(queued, "scan-work-queued", "scan", of), row(found, F.when(F.col("is_new"), "item-added").otherwise("item-updated"), "discover"), row(said, "enriched", "metadata"),
        row(said.join(artwork.select("file_id").distinct(), "file_id", "left_semi"), "artwork-updated", "metadata"), row(lost, "item-missing", "finish"), row(quiet, "item-added", "finish"),
    ]
    if "metadata" in files.columns:
        changed = field_events(files.select("file_id", "metadata"), metadata)
        changed = changed.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("changed"))
        parts.append(row(said.join(changed, "file_id"), "field-update", "metadata", F.col("changed")))
    return reduce(DataFrame.unionByName, parts)


def counted(roots, diffed, done, moves, enriched, artwork, asserted, claimed, others, troubles) -> DataFrame:
    """library_id and COUNTS of every library of roots."""

    def one(rows: DataFrame, **said: Column) -> DataFrame:
        return rows.select("library_id", *[said.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])

    status = F.col("status")
    unclaimed = others.join(claimed.select(*KEYS), list(KEYS), "left_anti")
    rows = [
        one(roots.select("library_id").distinct()), one(diffed, seen=status != "missing", missing=status == "missing", unchanged=status == "unchanged"), one(moves, missing=F.lit(-1)),
        one(done, discovered=F.lit(1), added=F.col("way") == "added", updated=F.col("way") == "updated", moved=F.col("way") == "moved"), one(enriched, enriched=F.lit(1)),
        one(enriched.join(artwork.select("file_id"), "file_id"), artwork=F.lit(1)), one(asserted, sidecars=F.lit(1)), one(unclaimed, skipped=F.lit(1)), one(troubles, errors=F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("library_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def told(scanned: Scanned, hooks: Hooks) -> Scanned:
    """Calls the observers, once the result is written. One that raises must not undo a scan: its message is kept."""
    for observer in hooks.observe:
        try:
            observer(scanned)
        except Exception as e:  # an observer's own trouble
            scanned.failures.append(f"{type(e).__name__}: {e}")
    return scanned

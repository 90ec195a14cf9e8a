"""The change feed: what a scan did, as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import changed_fields


def item_events(diffed: DataFrame, moves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by (a library), type, path, file_id: item-added, item-updated (changed and moved), item-missing, scan-work-queued."""
    at = [*by, "path"]
    rows = diffed.join(moves.select(*at, F.col("file_id").alias("moved_id")), at, "left").join(moves.select(*by, F.col("old_path").alias("path"), F.lit(True).alias("left")), at, "left")
    kind = F.when(F.col("moved_id").isNotNull() | (F.col("status") == "changed"), "item-updated").when(F.col("status") == "new", "item-added").when((F.col("status") == "missing") & F.col("left").isNull(), "item-missing")
    queued = F.when(F.col("status").isin("new", "changed"), "scan-work-queued")
    both = F.explode(F.array(F.struct(kind.alias("type"), F.coalesce("moved_id", "file_id").alias("file_id")), F.struct(queued.alias("type"), F.col("file_id"))))
    return rows.select(*by, "path", both.alias("told")).where("told.type IS NOT NULL").select(*by, "told.type", "path", "told.file_id")


def field_events(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """key, field, value of each metadata field that differs between old and new(key, metadata)."""
    both = old.select(key, F.col("metadata").alias("was")).join(new.select(key, F.col("metadata").alias("now")), key)
    return both.select(key, F.explode(changed_fields(F.col("was"), F.col("now"))).alias("field", "value"))


#: What a scan calls the phases that it goes through.
PHASES = ("scan", "discover", "metadata", "finish")


def phase_events(libraries: DataFrame) -> DataFrame:
    """type, library_id, path, file_id, phase, fields: the phases that the scan of each of libraries(library_id) went through."""
    phases = F.explode(F.array(*[F.lit(x) for x in PHASES])).alias("phase")
    none = lambda t: F.lit(None).cast(t)
    return libraries.select("library_id", phases).select(F.lit("scan-phase-changed").alias("type"), "library_id", none("string").alias("path"), none("long").alias("file_id"), "phase", none("map<string,string>").alias("fields"))


def with_revision(events: DataFrame, epoch: str, batch: int, parts: int = 256) -> DataFrame:
    """events with epoch and a revision that rises from batch to batch and is dense within one, up to 2^40 events; the same events get the same revisions when the plan runs again.

    Events are numbered in hashed parts, then shifted by the parts before, so no task gets all of them.
    """
    keys = [F.to_json(F.struct(*events.columns))]
    rows = events.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a part
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    rows = rows.withColumn("nth", nth).join(F.broadcast(sums), "part")
    return rows.withColumns({"epoch": F.lit(epoch), "revision": F.lit(batch).cast("long") * F.lit(1 << 40) + F.col("base") + F.col("nth") - 1}).drop("part", "nth", "base")


def snapshot(libraries: DataFrame, roots: DataFrame, jobs: DataFrame, work: DataFrame) -> DataFrame:
    """A row for each library: its roots that are there and not, its latest job's state, and its pending work."""
    counted = roots.groupBy("library_id").agg(F.count_if("available").alias("roots_there"), F.count_if(~F.col("available")).alias("roots_gone"))
    latest = jobs.groupBy("library_id").agg(F.max_by("state", "queue_order").alias("state"))
    pending = work.groupBy("library_id").agg(F.count(F.lit(1)).alias("pending"))
    out = libraries.join(counted, "library_id", "left").join(latest, "library_id", "left").join(pending, "library_id", "left")
    return out.fillna(0, ["roots_there", "roots_gone", "pending"])

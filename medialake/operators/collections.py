"""Ordered collections of items; the same item may stand in one more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Kept
from .places import placed

COLUMNS = ["collection_id", "position", "item_id"]


#: Entries of a block of an order that is read.
BLOCK = 10_000
#: Room between neighbours' labels.
GAP = 1 << 20


def dense(entries: DataFrame, *order: str) -> DataFrame:
    """Positions 0, 1, 2, ... of each collection, in the given order; a collection of any size is spread over many tasks."""
    return placed(entries, ["collection_id"], list(order), Kept(entries.sparkSession, "collections")).withColumn("position", F.col("place").cast("long")).select(*COLUMNS)


def in_order(entries: DataFrame, size: int = BLOCK) -> DataFrame:
    """collection_id, block, items: each collection in order, `size` entries to a block."""
    rows = placed(entries, ["collection_id"], ["position"], Kept(entries.sparkSession, "in-order"))
    items = F.array_sort(F.collect_list(F.struct("place", "item_id")))
    return rows.groupBy("collection_id", F.floor(F.col("place") / size).alias("block")).agg(F.transform(items, lambda e: e["item_id"]).alias("items"))


def create(collections: DataFrame, names: DataFrame) -> DataFrame:
    """collections(collection_id, name) with a new one for each row of names(name), also where a name is there already. Ids are dense above the greatest known, in the order of the names, 1 at first."""
    top = collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("top"))  # one row
    new = placed(names.select("name"), [], ["name"], Kept(names.sparkSession, "created")).crossJoin(F.broadcast(top))
    return collections.select("collection_id", "name").unionByName(new.select((F.col("top") + F.col("place") + 1).cast("long").alias("collection_id"), "name"))


def labelled(entries: DataFrame) -> DataFrame:
    """collection_id, label, item_id: entries in order under labels with gaps, so that a move or an append writes one row."""
    return dense(entries, "position").select("collection_id", ((F.col("position") + 1) * GAP).alias("label"), "item_id")


def move_label(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """collection_id, old_label, label of the one entry that each of moves(collection_id, source, target) moves; label is null where its new neighbours leave no room, and the collection must be `labelled` anew.

    At most one move a collection, as slots are counted before it. A move that goes nowhere, or names a slot that isn't there, gives no row.
    """
    known = labels.join(moves.select("collection_id").distinct(), "collection_id", "left_semi")
    rows = placed(known, ["collection_id"], ["label"], Kept(labels.sparkSession, "labels")).join(moves, "collection_id")
    place, source, target = F.col("place"), F.col("source"), F.col("target")
    low = F.when(target > source, target).otherwise(target - 1)
    at = lambda c: F.max(F.when(place == c, F.col("label")))
    near = rows.where((source != target) & (place.isin(source, target) | (place == low) | (place == low + 1)))
    found = near.groupBy("collection_id").agg(at(source).alias("old_label"), at(target).alias("there"), at(low).alias("below"), at(low + 1).alias("above"))
    middle = F.when(F.col("below").isNull(), F.col("above") - GAP).when(F.col("above").isNull(), F.col("below") + GAP).otherwise(F.floor((F.col("below") + F.col("above")) / 2))
    return found.where("old_label IS NOT NULL AND there IS NOT NULL").select("collection_id", "old_label", F.when(F.coalesce(middle > F.col("below"), F.lit(True)), middle).cast("long").alias("label"))


def relabel(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """labels with what move_label gave; only rows with room are changed."""
    new = changes.where("label IS NOT NULL").select("collection_id", F.col("old_label").alias("label"), F.col("label").alias("new_label"))
    return labels.join(new, ["collection_id", "label"], "left").select("collection_id", F.coalesce("new_label", "label").alias("label"), "item_id")


def append_labels(labels: DataFrame, additions: DataFrame) -> DataFrame:
    """The rows to add for additions(collection_id, position, item_id): behind the last label of their collection. What is there is only summed up."""
    last = labels.groupBy("collection_id").agg(F.max("label").alias("last"))
    new = dense(additions, "position").join(last, "collection_id", "left")
    return new.select("collection_id", (F.coalesce("last", F.lit(0)) + (F.col("position") + 1) * GAP).alias("label"), "item_id")


def set_entries(entries: DataFrame, orders: DataFrame) -> DataFrame:
    """entries with whole collections rewritten as orders(collection_id, position, item_id) have them, positions made dense."""
    return entries.select(*COLUMNS).join(orders.select("collection_id").distinct(), "collection_id", "left_anti").unionByName(dense(orders, "position"))


def append_entries(entries: DataFrame, additions: DataFrame) -> DataFrame:
    """entries with additions(collection_id, position, item_id) behind them, less those whose item the collection has; repeats within the additions stay."""
    new = additions.join(entries.select("collection_id", "item_id").distinct(), ["collection_id", "item_id"], "left_anti")
    last = entries.groupBy("collection_id").agg((F.max("position") + 1).alias("next"))
    new = dense(new, "position").join(last, "collection_id", "left").withColumn("position", F.col("position") + F.coalesce("next", F.lit(0)))
    return entries.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def resolve(entries: DataFrame, items: DataFrame) -> DataFrame:
    """entries with what items(item_id, ...) say; orphans are left out."""
    return entries.join(items, "item_id")


def union_once(entries: DataFrame) -> DataFrame:
    """Each item once, at its first place."""
    return dense(entries.groupBy("collection_id", "item_id").agg(F.min("position").alias("first")), "first")


def move(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """entries with at most one of moves(collection_id, source, target) for each collection: the entry at `source` lands at `target`."""
    rows = entries.join(moves, "collection_id", "left")
    p, a, b = F.col("position"), F.col("source"), F.col("target")
    landed = F.when(p == a, b).when((p > a) & (p <= b), p - 1).when((p < a) & (p >= b), p + 1).otherwise(p)
    return rows.withColumn("position", F.coalesce(landed, p)).select(*COLUMNS)


def shuffled(entries: DataFrame, seed: int) -> DataFrame:
    """A new order of each collection, the same for the same seed."""
    return dense(entries.withColumn("at", F.xxhash64(F.lit(seed), "collection_id", "position", "item_id")), "at", "position")

"""Live shelves: counts, sums and first rows kept by signed changes, so that a change costs what it touches and not the library."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.scratch import Kept

#: Most groups' keys that are sent to every executor.
SMALL = 1_000_000


@dataclass(frozen=True)
class Shelf:
    """keys: what makes a group, never null. order: columns that are unique among a group's rows; `first` is what the first row in this order says. sums: columns that are added up, nulls as 0."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    first: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.keys, *self.order, *self.first, *self.sums)))


def signed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `before` that are gone or changed, with sign -1, and those of `after` that are new or changed, with sign 1; a change is both. Each table is read and shuffled once."""
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.select(*before.columns).withColumn("sign", F.lit(1)))
    return both.repartition(*key).groupBy(*before.columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def imaged(updates: DataFrame, was: Column, now: Column) -> DataFrame:
    """What `signed` gives, of updates that say themselves what a row was and is now: structs of the same columns, null where there is no row. Nothing is looked up or shuffled."""
    images = F.array(*[F.struct(image.alias("row"), F.lit(sign).alias("sign")) for image, sign in ((was, -1), (now, 1))])
    return updates.where(~was.eqNullSafe(now)).select(F.explode(images).alias("image")).where("image.row IS NOT NULL").select("image.row.*", "image.sign")


def net(changes: DataFrame, shelf: Shelf) -> DataFrame:
    """The columns that make a first row and how many such rows came (or, below 0, went) in all; what came and went again is left out."""
    return changes.groupBy(*dict.fromkeys((*shelf.keys, *shelf.order, *shelf.first))).agg(F.sum("sign").alias("times")).where("times <> 0")


def place(shelf: Shelf) -> Column:
    return F.struct(*shelf.order)


def says(shelf: Shelf) -> Column:
    return F.struct(place(shelf).alias("place"), F.struct(*shelf.first).alias("first"))


def delta(changes: DataFrame, shelf: Shelf) -> DataFrame:
    """keys, d_n, d_<sum> and, where the shelf has first rows, came (the least row that came: place and first) and went (the least place that went) of changes; summed up before the shuffle.

    A row may come and go in the same changes, so came need not be there after them.
    """
    times, ends = F.col("sign").cast("long"), []
    if shelf.first:
        came, went = times > 0, times < 0
        ends = [F.min_by(F.when(came, says(shelf)), F.when(came, place(shelf))).alias("came"), F.min(F.when(went, place(shelf))).alias("went")]
    return changes.groupBy(*shelf.keys).agg(F.sum(times).alias("d_n"), *[F.sum(times * F.coalesce(c, F.lit(0))).alias(f"d_{c}") for c in shelf.sums], *ends)


def updated(state: DataFrame, changed: DataFrame, shelf: Shelf) -> DataFrame:
    """state(keys, n, sums, lead) with a delta's rows put in. `broken` is where a row went that is or precedes what would lead: only there must the group's rows be read, up to `bound` first. Shelves
    without first rows have neither."""
    both = state.join(changed, list(shelf.keys), "full")
    add = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))
    n, ends = add("n"), []
    if shelf.first:
        lead = F.when(F.col("lead").isNull() | (F.col("came.place") < F.col("lead.place")), F.coalesce("came", "lead")).otherwise(F.col("lead"))
        lost = F.col("went").isNotNull() & F.coalesce(F.col("went") <= lead["place"], F.lit(True))
        ends = [F.when(n > 0, lead).alias("lead"), (lost & (n > 0)).alias("broken"), F.col("came.place").alias("bound")]
    return both.select(*shelf.keys, n.cast("long").alias("n"), *[add(c).cast("long").alias(c) for c in shelf.sums], *ends)


def located(schema: StructType) -> StructType:
    """The schema with what the folders' names say."""
    return StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])


class LiveShelf:
    """A shelf under a folder: a log of signed changes and the groups' present state, both plain Parquet, partitioned by a hash of the group.

    A batch reads the state of the hash partitions that it touches, and the log of those alone whose first row went. It writes these partitions anew under its number, so a batch that is run
    again gives the same, and readers take each partition's latest. Groups that are empty now stay as rows of n = 0, so that an emptied partition isn't taken for an old one. The log takes changes
    as they come, without a shuffle; only groups are shuffled. A shelf without first rows has no log, as counts and sums need none.
    """

    def __init__(self, spark: SparkSession, folder: str, shelf: Shelf, schema, buckets: int = 256):
        self.spark, self.folder, self.shelf, self.schema, self.buckets = spark, folder.rstrip("/"), shelf, schema, buckets
        empty = self.logged(spark.createDataFrame([], schema).withColumn("sign", F.lit(1)))
        blank = delta(empty, shelf)
        lead = [F.col("came").alias("lead")] if shelf.first else []
        self.log_schema = empty.schema
        self.state_schema = updated(blank.select(*shelf.keys, F.col("d_n").alias("n"), *[F.col(f"d_{c}").alias(c) for c in shelf.sums], *lead), blank, shelf).drop("broken", "bound").schema

    def logged(self, changes: DataFrame) -> DataFrame:
        return changes.select(*self.shelf.columns, F.col("sign").cast("long").alias("sign"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.shelf.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def state(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The groups, empty ones too, of the given hash partitions or of all, as they were before a batch or are now."""
        if not self.exists("state"):
            return self.spark.createDataFrame([], self.state_schema)
        rows = self.spark.read.schema(located(self.state_schema)).parquet(f"{self.folder}/state")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        rows = rows if before is None else rows.where(F.col("batch") < before)
        latest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row a partition
        return rows.join(F.broadcast(latest), ["bucket", "batch"]).drop("bucket", "batch")

    def groups(self) -> DataFrame:
        """keys, n, sums and the columns of the first row, of all groups that have rows."""
        return self.state().where("n > 0").select(*self.shelf.keys, "n", *self.shelf.sums, *[F.col(f"lead.first.{c}").alias(c) for c in self.shelf.first])

    def apply(self, changes: DataFrame, number: int) -> DataFrame:
        """Takes in a batch of changes(columns of the shelf, sign), and gives the groups that it touched, as they are now."""
        shelf, kept, rows = self.shelf, Kept(self.spark, "live"), self.logged(changes)
        if shelf.first:
            path = f"{self.folder}/log/batch={number}"
            rows.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(path)
            rows = self.spark.read.schema(self.log_schema).parquet(path)
        changed = kept.save(delta(rows, shelf).withColumn("bucket", self.bucket()), "changed")
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # as many as there are partitions at most
        if not touched:
            return self.state().where("false")
        new = updated(self.state(touched, number), changed, shelf).withColumn("bucket", self.bucket())
        if shelf.first:
            new = self.led(kept.save(new, "new"), number, kept)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/batch={number}")
        told = self.state(touched).join(changed.select(*shelf.keys), list(shelf.keys), "left_semi")
        return told.select(*shelf.keys, "n", *shelf.sums, *[F.col(f"lead.first.{c}").alias(c) for c in shelf.first])

    def led(self, new: DataFrame, number: int, kept: Kept) -> DataFrame:
        """Updated groups with the first rows of broken ones from the log. What came last most often stays, so rows up to its place are looked at first, and all rows only of groups where none of these is left."""
        keys, found = list(self.shelf.keys), []
        broken = kept.save(new.where("broken").select(*keys, "bucket", "bound"), "broken")
        for within in ("place <= bound", "true"):
            count = broken.count()
            if not count:
                break
            parts = [r.bucket for r in broken.select("bucket").distinct().collect()]
            log = self.spark.read.schema(located(self.log_schema)).parquet(f"{self.folder}/log").where(F.col("bucket").isin(parts) & (F.col("batch") <= number)).drop("bucket", "batch")
            wanted = broken.drop("bucket")
            log = log.join(F.broadcast(wanted) if count <= SMALL else wanted, keys).withColumn("place", place(self.shelf)).where(within)
            found.append(kept.save(net(log, self.shelf).where("times > 0").groupBy(*keys).agg(F.min_by(says(self.shelf), place(self.shelf)).alias("found")), "found"))
            broken = broken.join(found[-1], keys, "left_anti")
        if found:
            new = new.join(reduce(DataFrame.unionByName, found), keys, "left").withColumn("lead", F.when(F.col("broken"), F.col("found")).otherwise(F.col("lead"))).drop("found")
        return new.drop("broken", "bound")


def keep_live(changes: DataFrame, shelves: dict[str, LiveShelf], checkpoint: str, out: str | None = None) -> None:
    """Runs what there is of a stream of changes(columns, sign) through all shelves; under `out`/<name> each batch leaves the groups that it touched."""

    def one(batch: DataFrame, number: int) -> None:
        for name, shelf in shelves.items():
            told = shelf.apply(batch, number)
            if out:
                told.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

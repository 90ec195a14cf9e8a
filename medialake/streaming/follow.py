"""Consumers of the change feed: they notice what they missed, take a snapshot, and go on from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Revisions of a batch of the feed: see changes.with_revision.
BATCH = 1 << 40
#: What a follower remembers: how far it is, since which of its batches its rows count, how long it has waited for what is missing, and how many snapshots it took.
MARK = StructType([StructField("epoch", StringType()), StructField("next", LongType()), StructField("since", LongType()), StructField("waited", LongType()), StructField("snapshots", LongType())])


def published(events: DataFrame, epoch: str, batch: int) -> DataFrame:
    """events as a batch of the feed: with epoch, revision, and `of`, how many events the batch has, by which a consumer sees that it has all of them."""
    from ..operators.changes import with_revision

    rows = with_revision(events, epoch, batch)
    return rows.join(F.broadcast(events.agg(F.count(F.lit(1)).alias("of"))), F.lit(True))  # one row


class Follower:
    """A table kept from a feed(epoch, revision, of, deleted, key, columns...) under a folder, as rows that are only added to; a key is what its highest revision says.

    Events may come late, again, or not at all. Whole batches are taken in as they follow on one another; the rest waits. Where a batch is missing for `patience` rounds, or the epoch is another,
    snapshot() is asked: epoch, the last batch that it holds, and its rows(key, columns...). Rounds are numbered by the stream; one that is run again writes the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, snapshot: Callable[[], tuple[str, int, DataFrame]], patience: int = 2):
        self.spark, self.folder, self.key, self.snapshot, self.patience = spark, folder.rstrip("/"), key, snapshot, patience
        self.columns = StructType.fromDDL(schema)
        self.feed = StructType([*self.columns.fields, StructField("deleted", BooleanType()), StructField("epoch", StringType()), StructField("revision", LongType()), StructField("of", LongType())])

    def read(self, name: str, schema: StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema.add("round", "long") if "round" not in schema.names else schema)
        return self.spark.read.schema(StructType([*[f for f in schema.fields if f.name != "round"], StructField("round", LongType())])).parquet(f"{self.folder}/{name}")

    def mark(self, before: int) -> tuple[str | None, int, int, int, int]:
        """epoch, next, since, waited, snapshots as they were before a round."""
        rows = self.read("mark", StructType(MARK.fields[:])).where(F.col("round") < before).orderBy(F.desc("round")).limit(1).collect()  # a row a round
        return tuple(rows[0][c] for c in MARK.names) if rows else (None, 0, 0, 0, 0)

    def write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/round={number}")

    def take(self, events: DataFrame, number: int) -> None:
        """One round: what has come is put to what waits, and what is whole and next is taken in."""
        epoch, following, since, waited, snapshots = self.mark(number)
        waiting = self.read("waiting", StructType(self.feed.fields[:])).where(F.col("round") == number - 1).drop("round")
        self.write(waiting.unionByName(events.select(*self.feed.names)).where(F.lit(epoch is None) | (F.col("epoch") != F.lit(epoch)) | (F.col("revision") >= following * BATCH)).dropDuplicates(["epoch", "revision"]), "heard", number)
        heard = self.read("heard", StructType(self.feed.fields[:])).where(F.col("round") == number).drop("round")
        batch = F.floor(F.col("revision") / BATCH).alias("batch")
        told = [(r.epoch, r.batch) for r in heard.groupBy("epoch", batch, "of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("of")).select("epoch", "batch").collect()]  # a row a batch that waits
        other = heard.where(F.lit(epoch is None) | (F.col("epoch") != F.lit(epoch))).select("epoch").limit(1).collect()
        last = following
        while (epoch, last) in told:
            last += 1
        behind = not heard.where((F.col("epoch") == F.lit(epoch)) & (F.col("revision") >= last * BATCH)).isEmpty() if epoch is not None else False
        waited = waited + 1 if behind and last == following else 0
        if other or waited > self.patience:
            epoch, held, rows = self.snapshot()
            rows = rows.select(*self.columns.names).withColumns({"deleted": F.lit(False), "revision": F.lit((held + 1) * BATCH - 1).cast("long")})
            since, waited, snapshots, following = number, 0, snapshots + 1, held + 1
            last = following
            while (epoch, last) in told:
                last += 1
            whole = heard.where((F.col("epoch") == epoch) & F.col("revision").between(following * BATCH, last * BATCH - 1))
            self.write(rows.unionByName(whole.select(*rows.columns)), "rows", number)
        else:
            whole = heard.where((F.col("epoch") == F.lit(epoch)) & F.col("revision").between(following * BATCH, last * BATCH - 1))
            self.write(whole.select(*self.columns.names, "deleted", "revision"), "rows", number)
        self.write(heard.where((F.col("epoch") == F.lit(epoch)) & (F.col("revision") >= last * BATCH)), "waiting", number)
        self.write(self.spark.createDataFrame([(epoch, last, since, waited, snapshots)], MARK), "mark", number)

    def table(self) -> DataFrame:
        """The rows as the consumer has them."""
        since = self.mark(1 << 62)[2]
        kept = StructType([*self.columns.fields, StructField("deleted", BooleanType()), StructField("revision", LongType())])
        rows = self.read("rows", kept).where(F.col("round") >= since)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.columns.names if c != self.key], "deleted"), "revision").alias("last"))
        return last.where("NOT last.deleted").select(*[F.col(c) if c == self.key else F.col(f"last.{c}").alias(c) for c in self.columns.names])

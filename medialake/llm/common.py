"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows whose ids are sent to every executor; beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that `removing` blocks are in, innermost last.
INNER: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named a local session gets a new one under /tmp; a cluster, whose executors share no such folder, an error."""
    if INNER:
        return INNER[-1]
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back: it cuts lineage, and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one call, in a folder of their own within the shared one; leaving the `with` block removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch(spark)}/tables-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove(self.folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, written and read back."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Removes a table that save gave and nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self.remove(folder)

    def remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def removing(spark: SparkSession) -> Iterator[None]:
    """What `saved` and Tables write within this block is removed at its end."""
    tables = Tables(spark)
    INNER.append(tables.folder)
    try:
        yield
    finally:
        INNER.pop()
        tables.remove(tables.folder)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Texts can be very long: bound an Arrow batch by rows and by bytes, unless the session already asks for fewer.

    The setting stays, as plans are made when their result is asked for.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key) or "").rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores: an input of one small file would keep one core busy. Larger inputs are left as they lie. For scans only: df is planned to count its partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; a null key counts as bucket -1, which no learner leaves out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of df, chosen by a hash of the key, so that every run takes the same rows; all where there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < math.floor(1_000_000 * most / n))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, buckets: int, held: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """doc_id, label, text of about `most` labelled documents that aren't held out (crc32 of the id, modulo buckets, is held), chosen by a hash of the id.

    One row an id, whatever repeats: the larger label, the smaller text. Null ids, labels other than 0 and 1 and labels without a document are left out, null texts count as
    empty. `most` bounds the labels that are broadcast and the rows that are joined by a map-side aggregation.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_bucket(F.col(id_col), buckets) != held))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = hash_sample(known, "label_id", most)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def all_labelled(docs: DataFrame, labels: DataFrame, label_col: str, buckets: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, label, text of every labelled document that isn't held out, by the rules of `labelled`. Texts are shuffled only where ids repeat or there are too many labels to broadcast."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_bucket(F.col(id_col), buckets) != held))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return rows
    again = rows.join(few(twice), "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.join(few(twice), "doc_id", "left_anti").unionByName(again)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs less the rows whose key is in `dropped`. The keys are broadcast only when their counted number is small."""
    gone = dropped.select(key)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")

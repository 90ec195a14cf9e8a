"""Exact duplicates by a content sort: texts are range-partitioned, sorted, and compared with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, saved

#: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 48, row_col: str | None = None, per_task: int = 100) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and row_col where it is given.

    Rows are range-partitioned by splitters that Spark samples from (first characters, digest, salt), sorted externally, and rows
    whose whole normalised texts equal their neighbour's form a run. Only texts that, by a sample of `per_task` rows a shuffle partition, hold more than a
    quarter of a partition's rows are salted, so that splitters fall inside their groups; their runs, at most four times as many texts as there are partitions,
    are put together by digest, and a difference between the whole texts of two such runs is an error. All other groups are one run each.

    Null texts count as empty, and empty texts equal each other. Of rows that repeat both id and text, one is kept. A null id is kept
    only where its whole group has none. Other columns are ignored. An empty table gives an empty result. row_col: a column that tells rows
    apart, carried along; of rows with the same id and text the one where it is least is kept.
    """
    spark = docs.sparkSession
    own = [row_col] if row_col else []

    def digested(some: DataFrame) -> DataFrame:
        rows = some.select(F.col(id_col).alias("doc_id"), *own, normalised(F.col(text_col)).alias("norm"))
        return rows.select("doc_id", *own, "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))

    tasks, n = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    share = min(1.0, per_task * tasks / max(1, n))
    with Tables(spark) as tables:
        often = digested(docs.sample(share, 7)).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("seen")).where((F.col("seen") >= 8) & (F.col("seen") * 4 * tasks >= share * n))
        hot = tables.save(often.select("text_sha256", F.ceil(8 * tasks * F.col("seen") / (share * n)).alias("salts")), "dedup-hot")
        rows = digested(docs).join(F.broadcast(hot), "text_sha256", "left")
        salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")), F.lit(-1)).alias("salt")
        ranged = rows.select("doc_id", *own, "text_sha256", "norm", F.substring("norm", 1, head).alias("head"), salt).repartitionByRange("head", "text_sha256", "salt")
        run = Window.partitionBy("head", "text_sha256", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last(), *own)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        runs = ranged.select("doc_id", *own, "text_sha256", "salt", "norm", F.row_number().over(run).alias("nth"), F.min("doc_id").over(whole).alias("run_min"), F.count(F.lit(1)).over(whole).alias("run_size"))
        text = F.when((F.col("nth") == 1) & (F.col("salt") >= 0), F.col("norm")).alias("text_of_run")
        runs = saved(runs.select("doc_id", *own, "text_sha256", "salt", "nth", "run_min", "run_size", text), "dedup-runs")

    one_text = F.assert_true(F.min("text_of_run") == F.max("text_of_run"), "two texts have the same SHA-256")
    groups = runs.where("nth = 1 AND salt >= 0").groupBy("text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", *own, "salt")).alias("first"), F.sum("run_size").alias("size"), one_text.alias("same"))
    groups = groups.select("text_sha256", F.col("first.doc_id").alias("group_min"), F.col("first.salt").alias("keep_salt"), F.coalesce(F.when(F.col("same").isNull(), F.col("size")), F.col("size")).alias("size"))
    out = runs.drop("text_of_run").join(F.broadcast(groups), "text_sha256", "left")
    alone = F.col("size").isNull()
    kept = (F.col("nth") == 1) & (alone | (F.col("salt") == F.col("keep_salt")))
    return out.select("doc_id", F.when(alone, F.col("run_min")).otherwise(F.col("group_min")).alias("keep_id"), F.coalesce("size", "run_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *own)

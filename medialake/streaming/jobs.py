"""Streams of folder changes and plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.paths import hidden_below


def seen_events(events: DataFrame) -> DataFrame:
    """events(library_id, root, path, ts) less those of names and folders that start with a dot below their root."""
    return events.where(~hidden_below(F.col("root"), F.col("path")))


def debounced_dirs(events: DataFrame, gap: str = "2 seconds", watermark: str = "10 seconds") -> DataFrame:
    """library_id, dirs, since, until: the folders of a library's events, gathered until it has been quiet for `gap`.

    By the events' times alone: in append mode a session comes out once the watermark has passed it, so the last one waits for a later event. `bursts.bursts` has a clock too. State grows with
    the distinct folders of an open burst.
    """
    named = events.withWatermark("ts", watermark)
    return named.groupBy("library_id", F.session_window("ts", gap).alias("burst")).agg(F.collect_set("dir").alias("dirs")).select("library_id", "dirs", F.col("burst.start").alias("since"), F.col("burst.end").alias("until"))


def with_debt(dirs: DataFrame, debt: DataFrame, busy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dirs(library_id, dir) that can be scanned now, and those owed: of a library that is being scanned, busy(library_id), nothing is, and all is kept for the next time."""
    every = dirs.select("library_id", "dir").unionByName(debt.select("library_id", "dir")).distinct()
    return every.join(busy, "library_id", "left_anti"), every.join(busy, "library_id", "left_semi")


def play_counts(plays: DataFrame) -> DataFrame:
    """item_id, plays; update mode."""
    return plays.groupBy("item_id").agg(F.count(F.lit(1)).alias("plays"))


def latest_progress(log: DataFrame) -> DataFrame:
    """item_id, last: the newest position of each item; update mode. A struct's maximum is kept as state, so late rows change nothing."""
    return log.groupBy("item_id").agg(F.max(F.struct("updated_at", "event_id", "position_ms")).alias("last"))


def counted(scan: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """scan(status), and the numbers of seen and changed files, which can be read once an action on it is done."""
    told = Observation(name)
    return scan.observe(told, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") != "unchanged").alias("changed")), told


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Runs what there is to its end, each micro-batch's rows in a folder of their own under path."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

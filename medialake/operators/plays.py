"""Play log and resume points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Kept
from .asof import as_of


def record_plays(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new plays at its end; one that doesn't say so is not completed. Nothing is merged: each play is a row."""
    done = F.coalesce(F.col("completed"), F.lit(False)) if "completed" in new.columns else F.lit(False)
    return log.unionByName(new.withColumn("completed", done))


def play_counts(plays: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, plays for every item: each row counts, completed or not."""
    counts = plays.groupBy("item_id").agg(F.count(F.lit(1)).alias("plays"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("plays", F.lit(0)).alias("plays"))


def recent_plays(plays: DataFrame, limit: int = 50) -> DataFrame:
    return plays.orderBy(F.desc("started_at"), F.desc("play_id")).limit(limit)


def latest_progress(log: DataFrame) -> DataFrame:
    """item_id, position_ms, updated_at: the last write wins, the higher event id among those of one moment."""
    last = F.max(F.struct("updated_at", "event_id", "position_ms")).alias("last")
    return log.groupBy("item_id").agg(last).select("item_id", "last.position_ms", "last.updated_at")


def progress_of(items: DataFrame, progress: DataFrame) -> DataFrame:
    return items.join(progress, "item_id", "left")


def timed_fraction(position: Column, duration: Column) -> Column:
    """0 to 1; 0 without a duration."""
    share = F.coalesce(F.try_divide(position.cast("double"), duration.cast("double")), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def page_fraction(page: Column, pages: Column) -> Column:
    return F.when(pages > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), page / (pages - 1)))).otherwise(0.0)


def locate_chapter(progress: DataFrame, chapters: DataFrame) -> DataFrame:
    """progress(item_id, position_ms) with chapter_ms (the start last passed), next_ms and previous_ms, from chapters(item_id, start_ms).

    The next stop is the first start over a second ahead; the previous one the chapter's own start if it is over three seconds back, else the start before it, else 0. Three as-of joins, so an
    item may have any number of stops and of positions.
    """
    kept, own = Kept(progress.sparkSession, "chapters"), list(progress.columns)
    stop = lambda name: chapters.select("item_id", F.col("start_ms").cast("long").alias("at_ms"), F.col("start_ms").cast("long").alias(name))
    rows = progress.withColumn("at_ms", F.col("position_ms").cast("long"))
    rows = as_of(rows, stop("chapter_ms"), ["item_id"], "at_ms", "chapter_ms", kept)
    rows = as_of(rows.withColumn("at_ms", F.col("position_ms").cast("long") + 1000), stop("next_ms"), ["item_id"], "at_ms", "next_ms", kept, forward=True)
    rows = as_of(rows.withColumn("at_ms", F.col("chapter_ms") - 1), stop("before_ms"), ["item_id"], "at_ms", "before_ms", kept)
    previous = F.when(F.col("position_ms") - F.col("chapter_ms") > 3000, F.col("chapter_ms")).otherwise(F.coalesce("before_ms", F.lit(0)))
    return rows.select(*own, "chapter_ms", "next_ms", previous.alias("previous_ms"))

"""History of scan jobs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States by what they mean.
PENDING = ("queued", "waiting")
FINAL = ("completed", "failed", "cancelled", "interrupted")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The job of each library with the highest queue order."""
    rest = [c for c in jobs.columns if c != "library_id"]
    return jobs.groupBy("library_id").agg(F.max_by(F.struct(*rest), F.struct("queue_order", "job_id")).alias("last")).select("library_id", "last.*")


def attempts(jobs: DataFrame) -> DataFrame:
    """A row for each attempt of jobs(job_id, attempts: JSON)."""
    each = F.from_json("attempts", "array<struct<attempt:int,state:string,reason:string>>")
    return jobs.select("job_id", F.explode(each).alias("a")).select("job_id", "a.*")


def activity(jobs: DataFrame) -> DataFrame:
    done = F.col("state").isin(*FINAL)
    return jobs.agg(F.count_if(~done & ~F.col("state").isin(*PENDING)).alias("running"), F.count_if(F.col("state").isin(*PENDING)).alias("queued"))


def partition_of(state: Column) -> Column:
    return F.when(state.isin(*PENDING), "pending").when(state.isin(*FINAL), "final").otherwise("running")


def elapsed_ms(started: Column, finished: Column, now: Column) -> Column:
    """0 for what never started."""
    at = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.coalesce(at(F.coalesce(finished.cast("timestamp"), now)) - at(started), F.lit(0))


def conflicts(jobs: DataFrame) -> DataFrame:
    """Libraries with more than one unfinished job."""
    return jobs.where(~F.col("state").isin(*FINAL)).groupBy("library_id").agg(F.count(F.lit(1)).alias("open_jobs")).where("open_jobs > 1")

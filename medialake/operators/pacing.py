"""Read budgets: how long each read must wait so that a library is read at a given rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Kept
from .places import SMALL
from .scan import reads_upto

MICROS = 1_000_000
WIDE = "decimal(38,0)"


def due(files: DataFrame, stage: str, bytes_per_second: int, order: str = "path") -> DataFrame:
    """files(size_bytes, ...) with cost and due_us: when, after the start, reading in this order at this rate is through with each file, a second's worth being free at once."""
    if bytes_per_second <= 0:
        raise ValueError("a rate must be positive")
    over = F.greatest(F.col("upto") - F.lit(bytes_per_second), F.lit(0)).cast("decimal(20,0)")
    return reads_upto(files, stage, order).withColumn("over", over).withColumn("due_us", F.expr(f"(over * {MICROS}) div {bytes_per_second}")).drop("upto", "over")


def waits(charges: DataFrame, rates: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """charges(library_id, at, bytes, ...) with debt (millionths of bytes) and wait_us, how long the read that is charged must wait: a token bucket that is a second deep.

    Each library has a rate of rates(library_id, bytes_per_second), the greatest if several; without one, or with 0, nothing waits, and a negative one is an error. A second's worth of bytes is free at
    once; what is owed beyond waits until it is paid at the rate. Time between charges pays too, but not beyond nothing owed. Charges of one time come in `order`, in any where they tie. A
    charge of no bytes, null or less, or without a time, neither counts nor waits, and has no debt.

    The debt after a charge is its running sum of bytes, less what time has paid by then, above the lowest that this was just before any charge so far. So a running sum and a running minimum say it;
    they are taken within ranges of (library, time) and carried from range to range, so that a library of any size is spread over many tasks.
    """
    kept = Kept(charges.sparkSession, "pacing")
    rate = F.max("bytes_per_second").cast("long")
    rated = rates.groupBy("library_id").agg(F.when(rate < 0, F.raise_error(F.lit("a rate must not be negative")).cast("long")).otherwise(F.nullif(rate, F.lit(0))).alias("rate"))
    keys = ["library_id", "at", *order]
    rows = charges.select(F.struct(*charges.columns).alias("row"), *keys, "bytes").join(rated, "library_id", "left")
    counts = F.coalesce((F.col("bytes") > 0) & F.col("at").isNotNull() & F.col("rate").isNotNull(), F.lit(False))
    sorts = [F.col(c).asc_nulls_first() for c in keys]
    dealt = rows.where(counts).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*sorts, F.col("tie")).sortWithinPartitions(*sorts, "tie")
    dealt = kept.save(dealt.select("row", "library_id", "at", "bytes", "rate", F.monotonically_increasing_id().alias("nth")), "charged").withColumn("part", F.shiftright("nth", 33))

    inside = Window.partitionBy("library_id", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    paid = F.unix_micros(F.col("at").cast("timestamp")).cast("decimal(19,0)") * F.col("rate").cast("decimal(18,0)")
    rows_in = dealt.withColumns({"cost": (F.col("bytes").cast("decimal(19,0)") * MICROS).cast(WIDE), "paid": paid.cast(WIDE)})
    rows_in = rows_in.withColumn("upto", F.sum("cost").over(inside).cast(WIDE))
    rows_in = rows_in.withColumn("ahead", F.col("upto") - F.col("cost") - F.col("paid"))
    parts = rows_in.groupBy("library_id", "part").agg(F.sum("cost").cast(WIDE).alias("total"), F.min("ahead").alias("low"))
    before = Window.partitionBy("library_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumn("base", F.coalesce(F.sum("total").over(before).cast(WIDE), F.lit(0).cast(WIDE)))
    parts = kept.save(parts.withColumn("carried", F.min(F.col("base") + F.col("low")).over(before)).select("library_id", "part", "base", "carried"), "ranges")
    parts = F.broadcast(parts) if parts.count() <= SMALL else parts

    owed = rows_in.withColumn("lowest", F.min("ahead").over(inside)).join(parts, ["library_id", "part"])
    owed = owed.withColumn("debt", F.col("base") + F.col("upto") - F.col("paid") - F.least("carried", F.col("base") + F.col("lowest")))
    owed = owed.withColumn("over", F.greatest(F.col("debt") - F.col("rate").cast("decimal(19,0)") * MICROS, F.lit(0).cast(WIDE)))
    owed = owed.select("row", F.col("debt").cast(WIDE).alias("debt"), F.expr("(2 * over + rate) div (2 * rate)").alias("wait_us"))
    others = rows.where(~counts).select("row", F.lit(None).cast(WIDE).alias("debt"), F.lit(0).cast("long").alias("wait_us"))
    return owed.unionByName(others).select("row.*", "debt", "wait_us")

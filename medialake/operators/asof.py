"""As-of joins: to each row the last row of another table at or before its time, or the first one after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Kept

#: Most rows of carried values that are sent to every executor.
SMALL = 1_000_000


def as_of(rows: DataFrame, stops: DataFrame, by: list[str], at: str, value: str, kept: Kept, forward: bool = False) -> DataFrame:
    """rows with `value` of stops(by, at, value): of the last stop of the same `by` whose `at` is not above the row's or, with forward, of the first whose `at` is above it; null where there is none.

    Both tables are laid end to end and range-partitioned by group and time, so a group of any size is spread over many tasks. Within a range the value is the last, or next, that a stop of the
    range has; for rows before the first stop, or behind the last, it is carried in from the ranges beside it, of which each says one value a group. Nulls of `by` meet each other; rows whose
    `at` is null get null. Stops of equal time and group count once, by their greatest value.
    """
    spec = {c: rows.schema[c].dataType for c in rows.columns}
    late = stops.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(value).alias("stop"))
    left = rows.select(*by, F.col(at), F.lit(1).alias("tag"), F.struct(*rows.columns).alias("row"), F.lit(None).cast(late.schema["stop"].dataType).alias("stop"))
    right = late.select(*by, F.col(at), F.lit(0).alias("tag"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), "stop")
    keys = [*[F.col(c).asc_nulls_first() for c in by], F.col(at).asc_nulls_first(), F.col("tag")]
    dealt = left.unionByName(right).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys).drop("tie")
    dealt = kept.save(dealt.withColumn("nth", F.monotonically_increasing_id()), "as-of").withColumn("part", F.shiftright("nth", 33))
    group = [f"group_{i}" for i in range(len(by))]
    dealt = dealt.withColumns({g: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for g, c in zip(group, by)})
    inside = Window.partitionBy(*group, "part").orderBy("nth")
    found = F.first("stop", True).over(inside.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("stop", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.where("tag = 0").groupBy(*group, "part").agg((F.min_by if forward else F.max_by)("stop", "nth").alias("end"))
    parts = dealt.select(*group, "part").distinct().join(ends, [*group, "part"], "left")
    beside = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("part") if forward else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = kept.save(parts.select(*group, "part", F.last("end", True).over(beside).alias("carried")), "carried")
    parts = F.broadcast(parts) if parts.count() <= SMALL else parts
    out = dealt.withColumn("found", found).where("tag = 1").join(parts, [*group, "part"])
    got = F.when(F.col(f"row.{at}").isNotNull(), F.coalesce("found", "carried"))
    return out.select(*[F.col(f"row.{c}").alias(c) for c in spec], got.alias(value))

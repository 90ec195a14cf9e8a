"""Dense places in an order, without any task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Kept

#: Most rows of running sums that are sent to every executor.
SMALL = 1_000_000


def placed(rows: DataFrame, by: list[str], order: list[str], kept: Kept, name: str = "place") -> DataFrame:
    """rows with their place (0, 1, ...) in this order, nulls first, among the rows that agree in `by`.

    One range partitioning by both; each range counts its rows of a group, and running sums of these counts shift the places within a range. The ranged rows are written, so a lost
    executor can't deal them anew. Rows that tie may stand in either order; a group of any size is spread over as many tasks as its rows need, ties included.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    dealt = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, "tie").drop("tie")
    dealt = kept.save(dealt.withColumn("row", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("row", 33))
    group = [f"group_{i}" for i in range(len(by))]  # as text that is never null, so that a null group meets itself
    dealt = dealt.withColumns({g: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for g, c in zip(group, by)})
    sums = dealt.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = kept.save(sums.select(*group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "sums")
    sums = F.broadcast(sums) if sums.count() <= SMALL else sums
    return dealt.join(sums, [*group, "part"]).withColumn(name, F.col("row") + F.col("shift")).drop(*group, "part", "row", "shift")

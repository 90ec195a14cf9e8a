"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges(u, v) -> (node, root): the smallest node of each node's component.

    Every round a node takes the least label among its neighbours, then that label's own label, and hands what it got to the node that its old
    label names, so that whole trees are hooked at once: a chain takes about log2 of its length in rounds, however it is numbered.
    Each round is written to `tables`, and the one before it removed. Labels only fall, and rounds go on until one changes nothing: then neighbours have one label.
    """
    pairs = tables.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "component-pairs")
    labels = tables.save(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "component-labels")
    while True:
        near = pairs.join(labels.select(F.col("u").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(near, "u").select("u", F.least("root", "near").alias("low"), "root")
        jump = labels.select(F.col("u").alias("low"), F.col("root").alias("beyond"))
        got = lower.join(jump, "low", "left").select("u", F.least("low", F.coalesce("beyond", "low")).alias("root"), F.col("root").alias("was"))
        told = F.array(F.struct("u", "root", "was"), F.struct(F.col("was").alias("u"), "root", F.lit(None).cast("long").alias("was")))
        new = tables.save(got.select(F.inline(told)).groupBy("u").agg(F.min("root").alias("root"), F.max("was").alias("was")), "component-labels")
        tables.drop(labels)
        labels = new.select("u", "root")
        if not new.where("root <> was").limit(1).count():
            break
    tables.drop(pairs)
    return labels.select(F.col("u").alias("node"), "root")

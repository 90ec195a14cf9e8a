"""Tags: a name in a namespace; `kind` and `format` are the system's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import format_tag

KEY = ["item_id", "namespace", "name"]


def parse(text: Column) -> Column:
    """struct(namespace, name), parted at the first slash; a bare word has the namespace ''."""
    at = F.instr(text, "/")
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise("").alias("namespace"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("name"))


def canonical() -> Column:
    return F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat("namespace", F.lit("/"), "name"))


def automatic(items: DataFrame) -> DataFrame:
    """item_id, namespace, name: the kind and the format of items(item_id, kind, path)."""
    tags = F.array(F.struct(F.lit("kind").alias("namespace"), F.col("kind").alias("name")), F.struct(F.lit("format").alias("namespace"), F.lower(format_tag(F.col("path"))).alias("name")))
    return items.select("item_id", F.explode(tags).alias("t")).select("item_id", "t.namespace", "t.name").where("name <> ''")


def add_tags(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    return tags.select(*KEY).union(incoming.select(*KEY)).distinct()


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, KEY, "left_anti")


def tags_of(tags: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, tags in canonical form and order, for every item; all in one aggregation."""
    told = tags.groupBy("item_id").agg(F.sort_array(F.collect_list(canonical())).alias("tags"))
    return items.select("item_id").join(told, "item_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def facets(tags: DataFrame) -> DataFrame:
    return tags.groupBy("namespace", "name").agg(F.count(F.lit(1)).alias("items"))


def first_format(tags: DataFrame) -> DataFrame:
    return tags.where("namespace = 'format'").groupBy("item_id").agg(F.min("name").alias("format"))

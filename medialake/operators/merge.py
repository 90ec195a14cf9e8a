"""Merging what several extractors say about a file: earlier tiers win, later ones fill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def is_empty(c: Column, kind) -> Column:
    if isinstance(kind, StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (ArrayType, MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def merged(name: str, kind, tier: str) -> Column:
    """The value of the lowest tier that has one. Maps are merged key by key; structs field by field."""
    c = F.col(name)
    if isinstance(kind, StructType):
        fields = [merged(f"{name}.{f.name}", f.dataType, tier).alias(f.name) for f in kind.fields]
        return F.struct(*fields)
    if isinstance(kind, MapType):
        pairs = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(~is_empty(c, kind), F.struct(F.col(tier).alias("tier"), F.map_entries(c).alias("pairs"))))), lambda t: t["pairs"]))
        first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
        return F.map_from_entries(first)
    return F.min_by(F.when(~is_empty(c, kind), c), F.when(~is_empty(c, kind), F.col(tier)))


def merge_tiers(files: DataFrame, tiers: DataFrame, key: str = "file_id", tier: str = "tier") -> DataFrame:
    """One row a file of files(key), with every other column of tiers(key, tier, ...) merged; a file that no tier speaks of has nulls."""
    columns = [f for f in tiers.schema.fields if f.name not in (key, tier)]
    told = tiers.groupBy(key).agg(*[merged(f.name, f.dataType, tier).alias(f.name) for f in columns])
    return files.join(told, key, "left")


def distinct_artwork(artwork: DataFrame, key: str = "file_id") -> DataFrame:
    """artwork(key, tier, seq, data, ...): each content once a file, from the lowest tier and place. Bytes are compared by hash, and ride along once."""
    others = [c for c in artwork.columns if c != key]
    rows = artwork.withColumn("content", F.sha2("data", 256))
    best = rows.groupBy(key, "content").agg(F.min_by(F.struct(*others), F.struct("tier", "seq")).alias("best"))
    return best.select(key, *[F.col(f"best.{c}") for c in others])

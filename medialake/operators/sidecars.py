"""Companion files: lyrics and subtitles by stem, folder art by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import sidecar_kind
from ..functions.paths import dirname, stem


def dotted_prefixes(name: Column) -> Column:
    """A stem and each of its beginnings that ends before a dot."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def associate(media: DataFrame, others: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by (a library), media_path, sidecar_path, kind from media(by, path) and others(by, path).

    A sidecar's stem is cut before each of its dots, and each beginning joined by equality to the media of its directory; the longest that
    meets any stays, with all media of that stem. Folder art serves every media file of its directory.
    """
    files = media.select(*by, F.col("path").alias("media_path"), dirname(F.col("path")).alias("dir"), stem(F.col("path")).alias("media_stem"))
    sides = others.select(*by, F.col("path").alias("sidecar_path"), dirname(F.col("path")).alias("dir"), sidecar_kind(F.col("path")).alias("kind")).where("kind IS NOT NULL")
    named = sides.where("kind <> 'artwork'").withColumn("media_stem", F.explode(dotted_prefixes(stem(F.col("sidecar_path")))))
    met = named.join(files, [*by, "dir", "media_stem"])
    best = F.rank().over(Window.partitionBy(*by, "sidecar_path").orderBy(F.length("media_stem").desc()))
    by_name = met.withColumn("nth", best).where("nth = 1")
    by_folder = sides.where("kind = 'artwork'").join(files, [*by, "dir"])
    columns = [*by, "media_path", "sidecar_path", "kind"]
    return by_name.select(*columns).unionByName(by_folder.select(*columns))


def dirty_directories(jobs: DataFrame, only: DataFrame, known: DataFrame, listed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by (a library), dir of changed jobs(by, path), of only(by, dir), and of sidecars(by, path, modified_s) that are new, of another second, or gone."""
    at = [*by, "path"]
    key = [*at, "modified_s"]
    changed = listed.select(*key).join(known.select(*key), key, "left_anti").select(*at).union(known.select(*at).join(listed.select(*at), at, "left_anti"))
    return jobs.select(*by, dirname(F.col("path")).alias("dir")).union(only.select(*by, "dir")).union(changed.select(*by, dirname(F.col("path")))).distinct()


def refresh(current: DataFrame, matches: DataFrame, dirty: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """current(by, media_path, sidecar_path, kind) with the rows of dirty directories(by, dir) replaced by the matches there."""
    placed = lambda df: df.withColumn("dir", dirname(F.col("media_path")))
    on = [*by, "dir"]
    return placed(current).join(dirty, on, "left_anti").unionByName(placed(matches).join(dirty, on, "left_semi")).drop("dir")

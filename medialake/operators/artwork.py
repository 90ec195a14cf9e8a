"""Pictures of files: which one stands, which are kept, which are still to be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname

ROLES = ["thumbnail", "embedded", "folder"]
#: Which roles a retention policy keeps.
POLICIES = {"everything": ["embedded", "thumbnail", "folder"], "thumbnailsOnly": ["thumbnail"], "none": [], "deferred": ["embedded", "folder"]}


def best_artwork(artworks: DataFrame, roles: list[str] = ROLES) -> DataFrame:
    """One row a file of artworks(file_id, seq, role, mime, data): the role that stands first in `roles`, then the first of it."""
    place = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    rows = artworks.withColumn("place", place).where("place > 0")
    best = F.min_by(F.struct(*[c for c in artworks.columns if c != "file_id"]), F.struct("place", "seq"))
    return rows.groupBy("file_id").agg(best.alias("best")).select("file_id", "best.*")


def kept(artworks: DataFrame, policy: str) -> DataFrame:
    return artworks.where(F.col("role").isin(*POLICIES[policy])) if POLICIES[policy] else artworks.limit(0)


def replace_artwork(artworks: DataFrame, role: str, incoming: DataFrame) -> DataFrame:
    """artworks with the incoming files' rows of one role replaced; other roles stay."""
    gone = incoming.select("file_id", F.lit(role).alias("role")).distinct()
    return artworks.join(gone, ["file_id", "role"], "left_anti").unionByName(incoming)


def sweep(files: DataFrame, artworks: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """file_id of files(file_id, kind, missing_s) that are there, no documents, and without a thumbnail; of members(file_id) only, if given."""
    rows = files.where("missing_s IS NULL AND kind <> 'document'").select("file_id").join(artworks.where("role = 'thumbnail'").select("file_id"), "file_id", "left_anti")
    return rows if members is None else rows.join(members.select("file_id"), "file_id", "left_semi")


def thumbnail_source(files: DataFrame, artworks: DataFrame) -> DataFrame:
    """file_id, source: an image is its own, else the embedded picture, else the folder's, else bare."""
    has = artworks.groupBy("file_id").agg(F.bool_or(F.col("role") == "embedded").alias("embedded"), F.bool_or(F.col("role") == "folder").alias("folder"))
    source = F.when(F.col("kind") == "image", "image").when(F.col("embedded"), "embedded").when(F.col("folder"), "folder").otherwise("bare")
    return files.join(has, "file_id", "left").select("file_id", source.alias("source"))


def fitted(width: Column, height: Column, longest: int = 256) -> Column:
    """struct(width, height) with the longer side at most `longest`; never enlarged."""
    long = F.greatest(width, height)
    scaled = lambda x: F.greatest(F.lit(1), F.round(x * longest / long)).cast("int")
    return F.when(long <= longest, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(F.struct(scaled(width).alias("width"), scaled(height).alias("height")))


def render_order(pending: DataFrame, promoted: DataFrame, bare: DataFrame) -> DataFrame:
    """pending(file_id) less the bare ones, promoted(file_id, place) first in their order, then by id."""
    rank = promoted.groupBy("file_id").agg(F.min("place").alias("place"))
    return pending.join(bare.select("file_id"), "file_id", "left_anti").join(rank, "file_id", "left").orderBy(F.col("place").asc_nulls_last(), "file_id")


def by_content(artworks: DataFrame) -> DataFrame:
    """content, files, bytes of each distinct picture; only hashes are shuffled."""
    rows = artworks.select("file_id", F.sha2("data", 256).alias("content"), F.octet_length("data").cast("long").alias("bytes"))
    return rows.groupBy("content").agg(F.count(F.lit(1)).alias("files"), F.max("bytes").alias("bytes"))


def misnamed(cache: DataFrame) -> DataFrame:
    """Rows of cache(name, data) whose name isn't the hash of their content."""
    return cache.where(F.col("name") != F.sha2("data", 256))


def attach_folder_art(files: DataFrame, pictures: DataFrame, artworks: DataFrame, dirty: DataFrame) -> DataFrame:
    """artworks after the folder pictures of dirty(dir) went to every file there; a thumbnail is made of one only where the file has none.

    files(file_id, path), pictures(path, mime, data). Bytes are joined by folder, and only in dirty folders.
    """
    there = files.withColumn("dir", dirname(F.col("path"))).join(dirty, "dir", "left_semi")
    art = pictures.withColumn("dir", dirname(F.col("path"))).groupBy("dir").agg(F.min_by(F.struct("mime", "data"), F.col("path")).alias("art"))
    found = there.join(art, "dir").select("file_id", F.lit(0).cast("long").alias("seq"), F.lit("folder").alias("role"), "art.mime", "art.data")
    cleared = artworks.join(there.select("file_id", F.lit("folder").alias("role")), ["file_id", "role"], "left_anti")
    bare = found.join(artworks.where("role = 'thumbnail'").select("file_id"), "file_id", "left_anti").withColumn("role", F.lit("thumbnail"))
    columns = ["file_id", "seq", "role", "mime", "data"]
    return cleared.select(*columns).unionByName(found).unionByName(bare)

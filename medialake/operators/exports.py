"""What an item says of itself by its kind: byline, facts, search document, books' columns, and the JSON that other programs get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as meta
from ..functions import values as val
from .shelves import camera
from .tags import tags_of

KINDS = ("audio", "video", "image", "document")


def read(items: DataFrame, column: str = "metadata") -> DataFrame:
    """items(kind, metadata as JSON) with a struct for each kind, null but for the item's own."""
    return items.withColumns({k: F.when(F.col("kind") == k, meta.decode(F.col(column), k)) for k in KINDS})


def by_kind(**said: Column) -> Column:
    """What the item's kind says; null for kinds of which nothing is said."""
    return F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in said.items()])


def title() -> Column:
    return by_kind(audio=F.col("audio.title"), video=F.col("video.title"), image=F.coalesce("image.title", F.lit("")), document=F.col("document.title"))


def byline() -> Column:
    """Artist, series or else year, author, or camera."""
    return by_kind(audio=F.col("audio.artist"), video=F.coalesce("video.series", F.col("video.year").cast("string")), document=F.col("document.author"), image=camera("image.cameraMake", "image.cameraModel"))


def count_of(items: Column) -> Column:
    """How many, null where there are none."""
    return F.when(F.size(items) > 0, F.size(items).cast("string"))


def facts_of(format_name: str = "format") -> Column:
    """label and value of the facts that the kind keeps, in reading order; those that are absent are left out. The item's format comes last."""
    text = lambda c: F.col(c).cast("string")
    size = lambda k, between: F.concat(text(f"{k}.width"), F.lit(between), text(f"{k}.height"))
    told = {
        "audio": [("Album", F.col("audio.album")), ("Year", text("audio.year")), ("Length", val.clock_text(F.col("audio.durationMs"))), ("Track", text("audio.trackNumber")), ("Bitrate", F.concat(text("audio.bitrateKbps"), F.lit(" kbps"))), ("Chapters", count_of(F.col("audio.chapters")))],
        "video": [("Year", text("video.year")), ("Length", val.clock_text(F.col("video.durationMs"))), ("Resolution", size("video", "×")), ("Codec", F.col("video.videoCodec")), ("Scenes", count_of(F.col("video.chapters")))],
        "document": [("Series", F.col("document.series")), ("Issue", F.concat(F.lit("#"), val.whole_or_decimal(F.col("document.issueNumber")))), ("Publisher", F.col("document.publisher")), ("Pages", text("document.pageCount"))],
        "image": [("Dimensions", size("image", " × ")), ("Taken", F.substring("image.takenAt", 1, 10))],
    }
    pairs = [F.struct(F.lit(label).alias("label"), F.when(F.col("kind") == k, value).alias("value")) for k, facts in told.items() for label, value in facts]
    last = F.struct(F.lit("Format").alias("label"), F.upper(format_name).alias("value"))
    return F.filter(F.array(*pairs, last), lambda f: f["value"].isNotNull())


def search_fields(items: DataFrame, tags: DataFrame) -> DataFrame:
    """item_id, title, artist, album, tags (in canonical form): the search document of each item of read(); a document's author is its artist, a picture without title has an empty one."""
    rows = items.select("item_id", title().alias("title"), by_kind(audio=F.col("audio.artist"), document=F.col("document.author")).alias("artist"), by_kind(audio=F.col("audio.album")).alias("album"))
    return rows.join(tags_of(tags, items), "item_id")


def books(items: DataFrame, format_name: str = "format") -> DataFrame:
    """item_id, title, author, book_kind, length (a sort key: milliseconds or pages) and length_text of the audio and documents of read()."""
    rows = items.where(F.col("kind").isin("audio", "document"))
    length = by_kind(audio=F.col("audio.durationMs"), document=F.col("document.pageCount").cast("long"))
    shown = by_kind(audio=val.clock_text(F.coalesce("audio.durationMs", F.lit(0))), document=F.concat(F.col("document.pageCount").cast("string"), F.lit(" pp")))
    kind = by_kind(audio=F.lit("audiobook"), document=F.coalesce(F.upper(format_name), F.lit("PDF")))
    return rows.select("item_id", title().alias("title"), by_kind(audio=F.col("audio.artist"), document=F.col("document.author")).alias("author"), kind.alias("book_kind"), length.alias("length"), F.coalesce(shown, F.lit("")).alias("length_text"))


def track_export(items: DataFrame) -> DataFrame:
    """item_id, json of the audio items of read() whose file is there (missing_s is null): the fields a list of tracks shows, nulls left out; the first of several genres."""
    m = "audio."
    fields = [F.col("item_id").alias("id"), F.col("file_id").alias("fileId"), "path", *[F.col(m + c).alias(c) for c in ("title", "artist", "album", "albumArtist")], F.col(m + "trackNumber").alias("track"), F.col(m + "discNumber").alias("disc"), F.col(m + "durationMs").alias("durationMs"), F.col(m + "year").alias("year"), F.get(F.col(m + "genres"), 0).alias("genre")]
    return items.where("kind = 'audio' AND missing_s IS NULL").select("item_id", F.to_json(F.struct(*fields)).alias("json"))


def item_export(items: DataFrame, tags: DataFrame) -> DataFrame:
    """item_id, json of items(item_id, file_id, path, kind, metadata as JSON): id, fileId, path, kind, metadata as an object, and tags in canonical form, as a list that may be empty."""
    rows = items.join(tags_of(tags, items), "item_id")
    head = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("file_id").alias("fileId"), "path", "kind"))
    tail = F.to_json(F.struct("tags"))
    joined = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit(","), F.expr("substring(tail, 2)"))
    return rows.withColumns({"head": head, "tail": tail}).select("item_id", joined.alias("json"))


def first_of(rows: DataFrame, items: str, name: str) -> DataFrame:
    """rows with the first of a list; null where the list is empty or null."""
    return rows.withColumn(name, F.get(items, 0))


def of_kinds(items: DataFrame, kinds: list[str]) -> DataFrame:
    return items.where(F.col("kind").isin(*kinds))


def by_day(rows: DataFrame, at: str) -> DataFrame:
    """day (year-month-day) and how many rows are of it; rows without a time are of no day."""
    return rows.where(F.col(at).isNotNull()).groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def counts(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"))

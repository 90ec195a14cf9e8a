"""Shelves: groups of a library's items with counts, playing time and what the first item says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def playtime(ms: str = "duration_ms") -> Column:
    return F.coalesce(F.sum(F.coalesce(ms, F.lit(0))), F.lit(0))


def shelf_artist() -> Column:
    return F.coalesce("album_artist", "artist")


def first_by(order: tuple[str, ...], *columns: str | Column) -> Column:
    """The columns of the first row; a null there stays null."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def music_summary(tracks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """songs, albums (distinct, null being one), playtime_ms, hours, minutes."""
    out = tracks.groupBy(*by).agg(F.count(F.lit(1)).alias("songs"), (F.countDistinct("album") + F.coalesce(F.max(F.col("album").isNull().cast("int")), F.lit(0))).alias("albums"), playtime().alias("playtime_ms"))
    minutes = F.floor(F.col("playtime_ms") / 60_000)
    return out.withColumns({"hours": F.floor(minutes / 60), "minutes": minutes % 60})


def albums(tracks: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """One row an album title: artist and year of its first track in shelf order, tracks, playtime_ms. Albums of one title are one."""
    rows = tracks.withColumn("album", F.coalesce("album", F.lit(UNKNOWN)))
    first = first_by(order, F.coalesce("album_artist", "artist", F.lit(UNKNOWN)).alias("artist"), "year")
    out = rows.groupBy(*by, "album").agg(first.alias("first"), F.count(F.lit(1)).alias("tracks"), playtime().alias("playtime_ms"))
    return out.select(*by, "album", "first.artist", "first.year", "tracks", "playtime_ms")


def artists(tracks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row an artist: albums (distinct, nulls not counted), songs, playtime_ms."""
    rows = tracks.withColumn("artist", F.coalesce("artist", F.lit(UNKNOWN)))
    return rows.groupBy(*by, "artist").agg(F.countDistinct("album").alias("albums"), F.count(F.lit(1)).alias("songs"), playtime().alias("playtime_ms"))


def of_artist(tracks: DataFrame, artist: str) -> DataFrame:
    """The tracks that an artist made, or whose album is theirs."""
    return tracks.where((F.coalesce("artist", F.lit(UNKNOWN)) == artist) | (F.col("album_artist") == artist))


def of_album(tracks: DataFrame, album: str) -> DataFrame:
    return tracks.where(F.coalesce("album", F.lit(UNKNOWN)) == album)


def artist_detail(tracks: DataFrame, artist: str) -> DataFrame:
    """Albums of an artist, a null title being `Unknown`: tracks, playtime_ms."""
    return of_artist(tracks, artist).groupBy(F.coalesce("album", F.lit(UNKNOWN)).alias("album")).agg(F.count(F.lit(1)).alias("tracks"), playtime().alias("playtime_ms"))


def series_key(fallback: str | None = UNKNOWN) -> Column:
    """Of a video its series or title, of audio its album or title, of a document its series; without any the fallback, or the title where that is None."""
    own = F.when(F.col("kind") == "video", F.coalesce("series", "title")).when(F.col("kind") == "audio", F.coalesce("album", "title")).when(F.col("kind") == "document", F.col("series"))
    return F.coalesce(own, F.col("title") if fallback is None else F.lit(fallback))


def series(items: DataFrame, order: tuple[str, ...], fallback: str | None = UNKNOWN) -> DataFrame:
    """One row a series: episodes, playtime_ms of audio and video, and the first episode's item as its cover."""
    timed = F.when(F.col("kind").isin("audio", "video"), F.col("duration_ms"))
    rows = items.withColumns({"series_key": series_key(fallback), "timed_ms": timed})
    return rows.groupBy("series_key").agg(F.count(F.lit(1)).alias("episodes"), playtime("timed_ms").alias("playtime_ms"), F.min_by("item_id", F.struct(*order)).alias("cover_item"))


def running_order() -> Column:
    return F.coalesce("disc_number", F.lit(1)) * 1000 + F.coalesce("track_number", F.lit(0))


def episode_order() -> Column:
    video = F.coalesce("season", F.lit(0)) * 1000 + F.coalesce("episode", F.lit(0))
    return F.when(F.col("kind") == "video", video).when(F.col("kind") == "audio", F.coalesce("track_number", F.lit(0))).otherwise(0)


def sort_shelf(rows: DataFrame, keys: dict[str, Column], order: tuple[str, ...], column: str | None = None, ascending: bool = True) -> DataFrame:
    """Sorted by the column's key, nulls last either way and ties in ascending shelf order; an unknown column gives shelf order."""
    ties = [F.col(c).asc() for c in order]
    if column not in keys:
        return rows.orderBy(*ties)
    key = keys[column]
    return rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), *ties)


def lower(c: str) -> Column:
    return F.lower(F.col(c))


def sorts(view: str) -> dict[str, Column]:
    """Column -> key of a view: songs, albums, artists, movies, gallery, books or comics."""
    return {
        "songs": {"track": F.col("track_number"), "title": lower("title"), "artist": lower("artist"), "album": lower("album"), "year": F.col("year"), "genre": lower("genre"), "format": F.col("format"), "bitrate": F.col("bitrate_kbps"), "time": F.col("duration_ms")},
        "albums": {"album": lower("album"), "artist": lower("artist"), "year": F.col("year"), "tracks": F.col("tracks"), "time": F.col("playtime_ms")},
        "artists": {"artist": lower("artist"), "albums": F.col("albums"), "songs": F.col("songs"), "time": F.col("playtime_ms")},
        "movies": {"title": lower("title"), "year": F.col("year"), "time": F.col("duration_ms"), "resolution": F.col("height"), "codec": lower("codec")},
        "gallery": {"title": F.lower(F.coalesce("title", "path")), "dimensions": F.col("width") * F.col("height"), "taken": F.col("taken_at"), "camera": lower("camera")},
        "books": {"title": lower("title"), "author": lower("author"), "kind": lower("kind"), "length": F.coalesce("duration_ms", "pages")},
        "comics": {"title": lower("title"), "series": lower("series"), "issue": F.col("issue_number"), "author": lower("author"), "pages": F.col("pages")},
    }[view]


def chosen_columns(rows: DataFrame, known: list[str], chosen: list[str] | None, default: list[str]) -> DataFrame:
    """The chosen columns in their order, unknown ones left out; the first known where none is left; the default where nothing was chosen."""
    wanted = default if chosen is None else [c for c in chosen if c in known]
    return rows.select(*(wanted or known[:1]))


def saved_order(rows: DataFrame, order: DataFrame, key: str, created: list[str]) -> DataFrame:
    """rows sorted: remembered keys first, as order(key, position) has them, each at its first place; then the others as created."""
    place = order.groupBy(key).agg(F.min("position").alias("place"))
    return rows.join(place, key, "left").orderBy(F.col("place").asc_nulls_last(), *created).drop("place")


def facts(*pairs: tuple[str, Column]) -> Column:
    """label and value of each fact that there is."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("label"), c.cast("string").alias("value")) for n, c in pairs]), lambda f: f["value"].isNotNull())


def episode_label() -> Column:
    return F.coalesce(F.concat(F.lit("S"), F.col("season").cast("string"), F.lit("E"), F.col("episode").cast("string")), F.concat(F.lit("E"), F.col("track_number").cast("string")))


def resolution() -> Column:
    return F.concat(F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"))


def camera(make: str = "make", model: str = "model") -> Column:
    return F.nullif(F.concat_ws(" ", make, model), F.lit(""))


def book_kind() -> Column:
    return F.when(F.col("kind") == "audio", "audiobook").otherwise(F.coalesce(F.upper("format"), F.lit("PDF")))


def items(rows: DataFrame, order: tuple[str, ...], kinds: list[str] | None = None, missing: bool = True) -> DataFrame:
    """The items of a library in the order they were added, of these kinds or of all; missing=False leaves out those whose `missing` is set."""
    found = rows if kinds is None else rows.where(F.col("kind").isin(*kinds))
    return (found if missing else found.where("NOT missing")).orderBy(*order)


def track_summaries(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """items of a music shelf: audio that is there, with what a list of tracks shows."""
    shown = ["title", "artist", "album", "album_artist", "track_number", "disc_number", "duration_ms", "year", "genre"]
    return rows.where("NOT missing").select(*order, *shown)


def artist_shown(lead: Column, band: Column, original: Column) -> Column:
    """The lead performer, else the band, else the original artist."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (lead, band, original)])

"""Queries of shelves, sorts, tags, collections and plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as val
from ..operators import collections, exports, plays, shelves, tags
from . import views as v
from .registry import query

ITEM = ", ".join(v.SHELF)


def playable(spark, sf):
    return v.tracks(spark, sf).where("NOT missing")


@query("pf01_items", f"SELECT {ITEM}, title, missing FROM tracks", "tracks")
def all_items(spark, sf):
    return shelves.items(v.tracks(spark, sf), v.SHELF).select(*v.SHELF, "title", "missing")


@query("pf03_track_summaries", f"SELECT {ITEM}, title, artist, album, album_artist, track_number, disc_number, duration_ms, CAST(year AS BIGINT) AS year, genre FROM tracks WHERE NOT missing", "tracks")
def track_summaries(spark, sf):
    return shelves.track_summaries(v.tracks(spark, sf), v.SHELF)


@query("pf04_by_kind", "SELECT doc_id, path FROM inv_base WHERE kind = 'video'", "inv_base")
def by_kind(spark, sf):
    return shelves.items(v.inv_base(spark, sf), ("doc_id",), ["video"]).select("doc_id", "path")


@query("pf05_shelf_artist", "SELECT coalesce(album_artist, artist) AS shelf_artist, count(*) AS tracks FROM tracks GROUP BY 1", "tracks")
def shelf_artists(spark, sf):
    return v.tracks(spark, sf).groupBy(shelves.shelf_artist().alias("shelf_artist")).agg(F.count("*").alias("tracks"))


@query("pf08_album_filter", f"SELECT {ITEM} FROM tracks WHERE coalesce(album, 'Unknown') = 'Unknown'", "tracks")
def album_tracks(spark, sf):
    return shelves.of_album(v.tracks(spark, sf), "Unknown").select(*v.SHELF)


@query("pf09_artist_filter", f"SELECT {ITEM} FROM tracks WHERE coalesce(artist, 'Unknown') = 'Supplier#000000001' OR album_artist = 'Supplier#000000001'", "tracks")
def artist_tracks(spark, sf):
    return shelves.of_artist(v.tracks(spark, sf), "Supplier#000000001").select(*v.SHELF)


#: The documents as items: metadata by kind, as JSON.
ITEMS_SQL = ", shown AS (SELECT doc_id AS item_id, doc_id + 7 AS file_id, path, kind, source, lang, size_bytes AS n FROM inv_base WHERE kind IS NOT NULL)"


def items_json(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, file_id, path, kind, metadata, missing_s: a third without artist or author, a fifth without length."""
    d, kind = F.col("doc_id"), F.col("kind")
    some = lambda c, n: F.when(d % n != 0, c)
    audio = F.to_json(F.struct(F.col("source").alias("title"), some(F.col("lang"), 3).alias("artist"), F.concat(F.lit("Album "), "lang").alias("album"), (F.lit(1990) + d % 30).alias("year"), (d % 12).alias("trackNumber"), F.lit(320).alias("bitrateKbps"), some(F.col("size_bytes") * 100, 5).alias("durationMs"), F.array("lang", "source").alias("genres")))
    video = F.to_json(F.struct(F.col("source").alias("title"), some(F.col("lang"), 3).alias("series"), (F.lit(1990) + d % 30).alias("year"), F.lit(1920).alias("width"), some(F.lit(1080), 5).alias("height"), F.lit("h264").alias("videoCodec"), F.array(F.struct(F.lit("one").alias("title"), F.lit(0).alias("startMs"))).alias("chapters")))
    image = F.to_json(F.struct(some(F.lit("Make"), 3).alias("cameraMake"), F.lit("Model").alias("cameraModel"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("2024-05-06T07:08:09").alias("takenAt")))
    paper = F.to_json(F.struct(F.concat("source", F.lit("!")).alias("title"), some(F.col("lang"), 3).alias("author"), some(F.col("size_bytes"), 5).alias("pageCount"), F.col("lang").alias("series"), F.when(d % 2 == 0, 3.5).otherwise(4.0).alias("issueNumber")))
    told = F.when(kind == "audio", audio).when(kind == "video", video).when(kind == "image", image).when(kind == "document", paper)
    return v.inv_base(spark, sf).where("kind IS NOT NULL").select(d.alias("item_id"), (d + 7).alias("file_id"), "path", "kind", told.alias("metadata"), F.expr("CASE WHEN doc_id % 23 = 0 THEN 1704070000 END").alias("missing_s"))


def items_shown(spark: SparkSession, sf: str) -> DataFrame:
    return exports.read(items_json(spark, sf))


@query("pf11_facts_by_kind", ITEMS_SQL + """ SELECT item_id, CASE kind WHEN 'audio' THEN CASE WHEN item_id % 3 <> 0 THEN lang END WHEN 'video' THEN CASE WHEN item_id % 3 <> 0 THEN lang ELSE CAST(1990 + item_id % 30 AS VARCHAR) END WHEN 'document' THEN CASE WHEN item_id % 3 <> 0 THEN lang END
    WHEN 'image' THEN CASE WHEN item_id % 3 <> 0 THEN 'Make Model' ELSE 'Model' END END AS byline,
  CASE kind WHEN 'audio' THEN concat_ws(';', 'Album=Album ' || lang, 'Year=' || (1990 + item_id % 30), CASE WHEN item_id % 5 <> 0 THEN 'Length=' || (n // 10 // 60) || ':' || lpad(CAST((n // 10) % 60 AS VARCHAR), 2, '0') END, 'Track=' || (item_id % 12), 'Bitrate=320 kbps')
    WHEN 'video' THEN concat_ws(';', 'Year=' || (1990 + item_id % 30), CASE WHEN item_id % 5 <> 0 THEN 'Resolution=1920×1080' END, 'Codec=h264', 'Scenes=1') WHEN 'image' THEN 'Dimensions=640 × 480;Taken=2024-05-06'
    ELSE concat_ws(';', 'Series=' || lang, 'Issue=#' || CASE WHEN item_id % 2 = 0 THEN '3.5' ELSE '4' END, CASE WHEN item_id % 5 <> 0 THEN 'Pages=' || n END) END || CASE WHEN item_id % 4 <> 0 THEN ';Format=' || upper(kind) ELSE '' END AS facts FROM shown""", "inv_base")
def facts_of_kinds(spark, sf):
    rows = items_shown(spark, sf).withColumn("format", F.when(F.col("item_id") % 4 != 0, F.col("kind")))
    told = F.array_join(F.transform(exports.facts_of(), lambda f: F.concat_ws("=", f["label"], f["value"])), ";")
    return rows.select("item_id", exports.byline().alias("byline"), told.alias("facts"))


@query("pf11_facts", f"SELECT {ITEM}, CAST(CASE WHEN artist IS NULL THEN 0 ELSE 1 END + CASE WHEN album IS NULL THEN 0 ELSE 1 END + CASE WHEN year IS NULL THEN 0 ELSE 1 END AS INTEGER) AS facts, coalesce('artist=' || artist, 'album=' || album, 'year=' || year) AS first_fact FROM tracks", "tracks")
def item_facts(spark, sf):
    told = shelves.facts(("artist", F.col("artist")), ("album", F.col("album")), ("year", F.col("year")))
    first = F.get(told, 0)
    return v.tracks(spark, sf).select(*v.SHELF, F.size(told).alias("facts"), F.concat(first["label"], F.lit("="), first["value"]).alias("first_fact"))


@query("pf12_labels", f"SELECT {ITEM}, coalesce('S' || disc_number || 'E' || track_number, 'E' || track_number) AS label FROM tracks", "tracks")
def episode_labels(spark, sf):
    rows = v.tracks(spark, sf).withColumns({"season": F.col("disc_number"), "episode": F.col("track_number")})
    return rows.select(*v.SHELF, shelves.episode_label().alias("label"))


@query("pf13_issue_labels", f"SELECT {ITEM}, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity + 0.5 AS VARCHAR) END AS issue FROM lineitem")
def issue_labels(spark, sf):
    n = F.col("l_quantity") + F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(0.5)
    return v.table(spark, sf, "lineitem").select(*v.SHELF, val.whole_or_decimal(n).alias("issue"))


@query("pf14_clock", f"SELECT {ITEM}, CAST(duration_ms // 60000 AS VARCHAR) || ':' || lpad(CAST((duration_ms // 1000) % 60 AS VARCHAR), 2, '0') AS clock FROM tracks", "tracks")
def clocks(spark, sf):
    return v.tracks(spark, sf).select(*v.SHELF, val.clock_text(F.col("duration_ms")).alias("clock"))


@query("pf15_resolution_camera", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size || '×' || p_size * 2 END AS resolution, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' ' || p_type WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS camera FROM part")
def resolutions(spark, sf):
    rows = v.table(spark, sf, "part").selectExpr("p_partkey", "p_size AS width", "CASE WHEN p_size % 3 <> 0 THEN p_size * 2 END AS height", "CASE WHEN p_partkey % 4 IN (0, 1) THEN p_brand END AS make", "CASE WHEN p_partkey % 4 IN (0, 2) THEN p_type END AS model")
    return rows.select("p_partkey", shelves.resolution().alias("resolution"), shelves.camera().alias("camera"))


@query("pf17_books", ITEMS_SQL + """ SELECT item_id, CASE WHEN kind = 'audio' THEN source ELSE source || '!' END AS title, CASE WHEN item_id % 3 = 0 THEN NULL ELSE lang END AS author, CASE WHEN kind = 'audio' THEN 'audiobook' WHEN item_id % 8 = 4 THEN 'PDF' ELSE 'TXT' END AS book_kind,
  CASE WHEN item_id % 5 = 0 THEN NULL WHEN kind = 'audio' THEN n * 100 ELSE n END AS length, CASE WHEN kind = 'audio' THEN (CASE WHEN item_id % 5 = 0 THEN 0 ELSE n // 10 END // 60) || ':' || lpad(CAST(CASE WHEN item_id % 5 = 0 THEN 0 ELSE n // 10 END % 60 AS VARCHAR), 2, '0')
  WHEN item_id % 5 = 0 THEN '' ELSE n || ' pp' END AS length_text FROM shown WHERE kind IN ('audio', 'document')""", "inv_base")
def books(spark, sf):
    rows = items_shown(spark, sf).withColumn("format", F.when(F.col("item_id") % 8 == 5, "txt"))
    return exports.books(rows)


@query("pf18_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1")
def days(spark, sf):
    return exports.by_day(v.table(spark, sf, "events"), "ts").withColumnRenamed("n", "events")


@query("sh01_music_summary", "SELECT songs, albums, playtime_ms, playtime_ms // 3600000 AS hours, (playtime_ms // 60000) % 60 AS minutes FROM (SELECT count(*) AS songs, count(DISTINCT album) + max(CASE WHEN album IS NULL THEN 1 ELSE 0 END) AS albums, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM tracks WHERE NOT missing)", "tracks")
def summary(spark, sf):
    return shelves.music_summary(playable(spark, sf))


@query("sh02_album_groups", "SELECT coalesce(album, 'Unknown') AS album, arg_min(coalesce(album_artist, artist, 'Unknown'), shelf) AS artist, list(CAST(year AS BIGINT) ORDER BY shelf)[1] AS year, count(*) AS tracks, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM ranked_tracks WHERE NOT missing GROUP BY 1", "ranked_tracks")
def album_groups(spark, sf):
    return shelves.albums(playable(spark, sf), v.SHELF)


@query("sh03_artist_groups", "SELECT coalesce(artist, 'Unknown') AS artist, count(DISTINCT album) AS albums, count(*) AS songs, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM tracks WHERE NOT missing GROUP BY 1", "tracks")
def artist_groups(spark, sf):
    return shelves.artists(playable(spark, sf))


@query("sh04_artist_detail", "SELECT coalesce(album, 'Unknown') AS album, count(*) AS tracks, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM tracks WHERE coalesce(artist, 'Unknown') = 'Supplier#000000002' OR album_artist = 'Supplier#000000002' GROUP BY 1", "tracks")
def artist_albums(spark, sf):
    return shelves.artist_detail(v.tracks(spark, sf), "Supplier#000000002")


SERIES = "SELECT CASE WHEN l_partkey % 4 = 0 THEN coalesce(album_artist, title) WHEN l_partkey % 4 = 1 THEN coalesce(album, title) WHEN l_partkey % 4 = 2 THEN coalesce(album_artist, {0}) ELSE {0} END AS series_key, count(*) AS episodes, CAST(sum(CASE WHEN l_partkey % 4 < 2 THEN coalesce(duration_ms, 0) ELSE 0 END) AS BIGINT) AS playtime_ms, arg_min(l_partkey, shelf) AS cover_item FROM ranked_tracks GROUP BY 1"


def series_items(spark, sf):
    kind = F.get(F.array(F.lit("video"), F.lit("audio"), F.lit("document"), F.lit("image")), (F.col("l_partkey") % 4).cast("int"))
    return v.tracks(spark, sf).withColumns({"kind": kind, "series": F.col("album_artist"), "item_id": F.col("l_partkey")})


@query("sh06_series", SERIES.format("'Unknown'"), "ranked_tracks")
def series_shelf(spark, sf):
    return shelves.series(series_items(spark, sf), v.SHELF)


@query("sh07_shows", SERIES.format("title"), "ranked_tracks")
def shows_shelf(spark, sf):
    return shelves.series(series_items(spark, sf), v.SHELF, None)


@query("sh10_counts", "SELECT source, kind, count(*) AS items FROM inv_base GROUP BY source, kind", "inv_base")
def kind_counts(spark, sf):
    return exports.counts(v.inv_base(spark, sf), ["source", "kind"])


@query("so01_songs_by_year_desc", f"SELECT {ITEM}, CAST(year AS BIGINT) AS year FROM tracks ORDER BY year DESC NULLS LAST, {ITEM}", "tracks")
def songs_by_year(spark, sf):
    keys = {"year": F.col("year")}
    return shelves.sort_shelf(v.tracks(spark, sf), keys, v.SHELF, "year", ascending=False).select(*v.SHELF, "year")


@query("so03_albums_by_time", "SELECT album, playtime_ms FROM (SELECT coalesce(album, 'Unknown') AS album, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM tracks WHERE NOT missing GROUP BY 1)", "tracks")
def albums_by_time(spark, sf):
    rows = shelves.albums(playable(spark, sf), v.SHELF)
    return shelves.sort_shelf(rows, shelves.sorts("albums"), ("album",), "time", ascending=False).select("album", "playtime_ms")


@query("so04_artists_by_songs", "SELECT artist, songs FROM (SELECT coalesce(artist, 'Unknown') AS artist, count(*) AS songs FROM tracks WHERE NOT missing GROUP BY 1) ORDER BY songs DESC, artist", "tracks")
def artists_by_songs(spark, sf):
    rows = shelves.artists(playable(spark, sf))
    return shelves.sort_shelf(rows, shelves.sorts("artists"), ("artist",), "songs", ascending=False).select("artist", "songs")


@query("so05_running_order", f"SELECT {ITEM}, CAST(coalesce(disc_number, 1) * 1000 + coalesce(track_number, 0) AS BIGINT) AS place FROM tracks", "tracks")
def running(spark, sf):
    return v.tracks(spark, sf).select(*v.SHELF, shelves.running_order().cast("long").alias("place"))


@query("so06_episode_order", f"SELECT {ITEM}, CAST(CASE WHEN l_partkey % 4 = 0 THEN coalesce(disc_number, 0) * 1000 + track_number WHEN l_partkey % 4 = 1 THEN track_number ELSE 0 END AS BIGINT) AS place FROM tracks", "tracks")
def episodes(spark, sf):
    rows = series_items(spark, sf).withColumns({"season": F.col("disc_number"), "episode": F.col("track_number")})
    return rows.select(*v.SHELF, shelves.episode_order().cast("long").alias("place"))


@query("so07_movies_by_resolution", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END AS height FROM part ORDER BY height DESC NULLS LAST, p_partkey")
def movies(spark, sf):
    rows = v.table(spark, sf, "part").withColumn("height", F.when(F.col("p_size") % 5 != 0, F.col("p_size")))
    return shelves.sort_shelf(rows, {"resolution": F.col("height")}, ("p_partkey",), "resolution", ascending=False).select("p_partkey", "height")


@query("so11_recent_plays", "SELECT play_id, item_id, started_at, completed FROM plays ORDER BY started_at DESC, play_id DESC LIMIT 50", "plays")
def recent(spark, sf):
    return plays.recent_plays(v.plays(spark, sf))


@query("so14_saved_order", "SELECT item_id, row_number() OVER (ORDER BY place NULLS LAST, item_id) AS nth FROM (SELECT item_id, min(CASE WHEN collection_id = 1 THEN position END) AS place FROM entries GROUP BY item_id)", "entries")
def remembered(spark, sf):
    from pyspark.sql import Window

    rows = v.entries(spark, sf)
    place = rows.where("collection_id = 1").groupBy("item_id").agg(F.min("position").alias("place"))
    items = shelves.saved_order(rows.select("item_id").distinct(), rows.where("collection_id = 1"), "item_id", ["item_id"]).join(place, "item_id", "left")
    return items.select("item_id", F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), "item_id")).cast("long").alias("nth"))  # a few distinct ids


@query("so13_chosen_columns", "SELECT album, title FROM tracks", "tracks")
def chosen(spark, sf):
    return shelves.chosen_columns(v.tracks(spark, sf), ["title", "artist", "album"], ["album", "nonsense", "title"], ["title"])


@query("ta01_parse", "SELECT page_id, CASE WHEN strpos(t, '/') > 0 THEN substr(t, 1, strpos(t, '/') - 1) ELSE '' END AS namespace, CASE WHEN strpos(t, '/') > 0 THEN substr(t, strpos(t, '/') + 1) ELSE t END AS name FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'plain' ELSE url END AS t FROM pages)")
def parsed(spark, sf):
    text = F.when(F.col("page_id") % 3 == 0, "plain").otherwise(F.col("url"))
    return v.table(spark, sf, "pages").select("page_id", tags.parse(text).alias("t")).select("page_id", "t.namespace", "t.name")


@query("ta03_automatic", "SELECT doc_id AS item_id, 'kind' AS namespace, kind AS name FROM inv_base WHERE kind IS NOT NULL UNION ALL SELECT doc_id, 'format', CASE doc_id % 8 WHEN 3 THEN 'jpg' ELSE lower(regexp_extract(path, '[^.]*$')) END FROM inv_base WHERE kind IS NOT NULL", "inv_base")
def automatic_tags(spark, sf):
    return tags.automatic(v.inv_base(spark, sf).where("kind IS NOT NULL").withColumnRenamed("doc_id", "item_id"))


@query("ta04_add", "SELECT item_id, namespace, name FROM item_tags UNION SELECT item_id, 'quality', '1' FROM item_tags", "item_tags")
def added(spark, sf):
    rows = v.item_tags(spark, sf)
    return tags.add_tags(rows, rows.select("item_id", F.lit("quality").alias("namespace"), F.lit("1").alias("name")))


@query("ta05_remove", "SELECT item_id, namespace, name FROM item_tags WHERE NOT (namespace = 'toxic' AND name = '0')", "item_tags")
def removed(spark, sf):
    rows = v.item_tags(spark, sf)
    return tags.remove_tags(rows, rows.where("namespace = 'toxic' AND name = '0'"))


@query("ta06_tags_of", "SELECT doc_id AS item_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN (SELECT item_id, string_agg(namespace || '/' || name, ' ' ORDER BY namespace || '/' || name) AS tags FROM item_tags GROUP BY item_id) t ON doc_id = t.item_id", "item_tags")
def tags_of_items(spark, sf):
    items = v.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return tags.tags_of(v.item_tags(spark, sf), items).select("item_id", F.array_join("tags", " ").alias("tags"))


@query("ta07_facets", "SELECT namespace, name, count(*) AS items FROM item_tags GROUP BY namespace, name", "item_tags")
def facet_counts(spark, sf):
    return tags.facets(v.item_tags(spark, sf))


@query("co02_in_order", "SELECT collection_id, (position_ - 1) // 3 AS block, string_agg(item_id, ' ' ORDER BY position) AS items FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY position) AS position_ FROM entries) GROUP BY 1, 2", "entries")
def ordered(spark, sf):
    return collections.in_order(v.entries(spark, sf), 3).select("collection_id", "block", F.array_join("items", " ").alias("items"))


@query("co08_labels", """, n AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY position) - 1 AS place, count(*) OVER (PARTITION BY collection_id) AS size FROM entries)
SELECT collection_id, CASE WHEN place = 0 THEN size - 1 ELSE place - 1 END AS position, item_id FROM n UNION ALL SELECT collection_id, size, 'last' FROM n WHERE place = 0""", "entries")
def label_moves(spark, sf):
    """By labels with gaps: the first entry of each collection goes behind all others, then one more is appended. Each writes one row a collection."""
    labels = collections.labelled(v.entries(spark, sf))
    sizes = labels.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    labels = collections.relabel(labels, collections.move_label(labels, sizes.select("collection_id", F.lit(0).alias("source"), (F.col("n") - 1).alias("target"))))
    new = collections.append_labels(labels, sizes.select("collection_id", F.lit(0).alias("position"), F.lit("last").alias("item_id")))
    return collections.dense(labels.unionByName(new), "label")


@query("co03_rewrite", "SELECT collection_id, CASE WHEN collection_id % 3 = 0 THEN row_number() OVER (PARTITION BY collection_id ORDER BY CASE WHEN collection_id % 3 = 0 THEN -position ELSE position END) - 1 ELSE position END AS position, item_id FROM entries", "entries")
def rewritten(spark, sf):
    rows = v.entries(spark, sf)
    return collections.set_entries(rows, rows.where("collection_id % 3 = 0").withColumn("position", -F.col("position")))


@query("co04_append", """, additions AS (SELECT collection_id, position, CASE WHEN position % 2 = 0 THEN item_id ELSE 'new:' || position % 3 END AS item_id FROM entries WHERE collection_id % 2 = 0),
fresh AS (SELECT a.* FROM additions a WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.collection_id = a.collection_id AND e.item_id = a.item_id))
SELECT collection_id, position, item_id FROM entries UNION ALL SELECT f.collection_id, row_number() OVER (PARTITION BY f.collection_id ORDER BY f.position) - 1 + m.next, f.item_id FROM fresh f JOIN (SELECT collection_id, max(position) + 1 AS next FROM entries GROUP BY 1) m ON f.collection_id = m.collection_id""", "entries")
def appended(spark, sf):
    rows = v.entries(spark, sf)
    extra = rows.where("collection_id % 2 = 0").withColumn("item_id", F.when(F.col("position") % 2 == 0, F.col("item_id")).otherwise(F.concat(F.lit("new:"), (F.col("position") % 3).cast("string"))))
    return collections.append_entries(rows, extra)


@query("co05_resolve", "SELECT collection_id, position, item_id, length(item_id) AS size FROM entries WHERE item_id LIKE 'user:%'", "entries")
def resolved(spark, sf):
    rows = v.entries(spark, sf)
    items = rows.where("item_id LIKE 'user:%'").select("item_id").distinct().withColumn("size", F.length("item_id").cast("long"))
    return collections.resolve(rows, items).select("collection_id", "position", "item_id", "size")


@query("co07_union_once", "SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY first) - 1 AS position, item_id FROM (SELECT collection_id, item_id, min(position) AS first FROM entries GROUP BY 1, 2)", "entries")
def once(spark, sf):
    return collections.union_once(v.entries(spark, sf))


@query("co08_move", "SELECT collection_id, CASE WHEN position = 0 THEN 1 WHEN position = 1 THEN 0 ELSE position END AS position, item_id FROM entries WHERE collection_id IN (SELECT collection_id FROM entries GROUP BY 1 HAVING count(*) > 1)", "entries")
def moved_entries(spark, sf):
    rows = v.entries(spark, sf)
    some = rows.groupBy("collection_id").count().where("count > 1").select("collection_id", F.lit(0).alias("source"), F.lit(1).alias("target"))
    return collections.move(rows.join(some.select("collection_id"), "collection_id", "left_semi"), some)


@query("co09_shuffle")
def shuffle(spark, sf):
    return collections.shuffled(v.entries(spark, sf), 7)


@query("pl02_play_counts", "SELECT c_custkey AS item_id, coalesce(n, 0) AS plays FROM customer LEFT JOIN (SELECT item_id, count(*) AS n FROM plays GROUP BY item_id) p ON c_custkey = p.item_id", "plays")
def counted(spark, sf):
    return plays.play_counts(v.plays(spark, sf), v.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id")))


@query("pl04_progress", "SELECT item_id, position_ms, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, event_id DESC) AS nth FROM progress_log) WHERE nth = 1", "progress_log")
def progress(spark, sf):
    return plays.latest_progress(v.progress_log(spark, sf))


@query("pl06_fractions", "SELECT event_id, round(least(1.0, greatest(0.0, CASE WHEN item_id % 5 = 0 THEN 0.0 ELSE position_ms / 60000.0::DOUBLE END)), 9)::DOUBLE AS fraction FROM progress_log", "progress_log")
def fractions(spark, sf):
    duration = F.when(F.col("item_id") % 5 != 0, 60000)
    return v.progress_log(spark, sf).select("event_id", F.round(plays.timed_fraction(F.col("position_ms"), duration), 9).alias("fraction"))


@query("pl07_chapters", """, chapters AS (SELECT DISTINCT item_id, k * 5000 AS start_ms FROM progress_log, (VALUES (0), (1), (2), (4), (8)) AS t(k))
SELECT p.event_id, CAST(max(start_ms) FILTER (start_ms <= position_ms) AS BIGINT) AS chapter_ms, CAST(min(start_ms) FILTER (start_ms > position_ms + 1000) AS BIGINT) AS next_ms,
  CAST(CASE WHEN position_ms - max(start_ms) FILTER (start_ms <= position_ms) > 3000 THEN max(start_ms) FILTER (start_ms <= position_ms)
    ELSE coalesce(list_reverse_sort(list(start_ms) FILTER (start_ms <= position_ms))[2], 0) END AS BIGINT) AS previous_ms
FROM progress_log p JOIN chapters c ON p.item_id = c.item_id GROUP BY p.event_id, position_ms""", "progress_log")
def chapters(spark, sf):
    log = v.progress_log(spark, sf)
    starts = log.select("item_id").distinct().select("item_id", F.explode(F.array(*[F.lit(k * 5000).cast("long") for k in (0, 1, 2, 4, 8)])).alias("start_ms"))
    return plays.locate_chapter(log, starts).select("event_id", "chapter_ms", "next_ms", "previous_ms")


@query("pf02_audio_items", "SELECT doc_id, path FROM inv_base WHERE kind = 'audio'", "inv_base")
def audio_items(spark, sf):
    return exports.of_kinds(v.inv_base(spark, sf), ["audio"]).select("doc_id", "path")


@query("pf06_first_genre", f"SELECT {ITEM}, genre AS first_genre FROM tracks", "tracks")
def first_genre(spark, sf):
    return exports.first_of(v.tracks(spark, sf).withColumn("genres", F.array("genre", "title")), "genres", "first_genre").select(*v.SHELF, "first_genre")


@query("pf07_format_tags", "SELECT doc_id AS item_id, CASE doc_id % 8 WHEN 3 THEN 'jpg' ELSE lower(regexp_extract(path, '[^.]*$')) END AS format FROM inv_base WHERE kind IS NOT NULL", "inv_base")
def format_tags(spark, sf):
    return tags.first_format(tags.automatic(v.inv_base(spark, sf).where("kind IS NOT NULL").withColumnRenamed("doc_id", "item_id")))


@query("pf10_series_filter", f"SELECT {ITEM} FROM ranked_tracks WHERE CASE WHEN l_partkey % 4 = 0 THEN coalesce(album_artist, title) WHEN l_partkey % 4 = 1 THEN coalesce(album, title) WHEN l_partkey % 4 = 2 THEN coalesce(album_artist, 'Unknown') ELSE 'Unknown' END = 'Unknown'", "ranked_tracks")
def of_series(spark, sf):
    return series_items(spark, sf).where(shelves.series_key() == "Unknown").select(*v.SHELF)


@query("pf19_titles", ITEMS_SQL + " SELECT item_id, CASE kind WHEN 'image' THEN '' WHEN 'document' THEN source || '!' ELSE source END AS title FROM shown", "inv_base")
def titles_by_kind(spark, sf):
    return items_shown(spark, sf).select("item_id", exports.title().alias("title"))


SONG_KEYS = {"track": "track_number", "title": "lower(title)", "artist": "lower(artist)", "album": "lower(album)", "genre": "lower(genre)", "time": "duration_ms"}
SONG_KEYS |= {"year": "year", "format": "format", "bitrate": "bitrate_kbps"}
#: tracks with what their files say.
SONGS = ("CASE WHEN l_partkey % 9 <> 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' ELSE 'm4a' END END AS format", "CASE WHEN l_suppkey % 4 <> 0 THEN 64 * (1 + l_partkey % 5) END AS bitrate_kbps")


def first_songs(column: str, ascending: bool):
    def run(spark, sf):
        return shelves.sort_shelf(v.tracks(spark, sf).selectExpr("*", *SONGS), shelves.sorts("songs"), v.SHELF, column, ascending).select(*v.SHELF)

    return run


for _column, _key in SONG_KEYS.items():
    for _up in (True, False):
        query(f"so02_songs_{_column}_{'asc' if _up else 'desc'}", f"SELECT {ITEM} FROM (SELECT *, {', '.join(SONGS)} FROM tracks) ORDER BY {_key} {'ASC' if _up else 'DESC'} NULLS LAST, {ITEM}", "tracks")(first_songs(_column, _up))


@query("so08_gallery_by_dimensions", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_size % 4 <> 0 THEN p_size * p_size * 2 END DESC NULLS LAST, p_partkey")
def gallery(spark, sf):
    rows = v.table(spark, sf, "part").selectExpr("p_partkey", "p_name AS title", "p_brand AS path", "p_size AS width", "CASE WHEN p_size % 4 <> 0 THEN p_size * 2 END AS height", "p_type AS camera", "p_size AS taken_at")
    return shelves.sort_shelf(rows, shelves.sorts("gallery"), ("p_partkey",), "dimensions", False).select("p_partkey")


@query("so09_books_by_length", "SELECT p_partkey FROM part ORDER BY CASE p_partkey % 3 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size END ASC NULLS LAST, p_partkey")
def books_by_length(spark, sf):
    rows = v.table(spark, sf, "part").selectExpr("p_partkey", "p_name AS title", "p_brand AS author", "p_type AS kind", "CASE p_partkey % 3 WHEN 0 THEN p_size * 1000 END AS duration_ms", "CASE p_partkey % 3 WHEN 1 THEN p_size END AS pages")
    return shelves.sort_shelf(rows, shelves.sorts("books"), ("p_partkey",), "length").select("p_partkey")


@query("so10_comics_by_issue", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 END DESC NULLS LAST, p_partkey")
def comics_by_issue(spark, sf):
    rows = v.table(spark, sf, "part").selectExpr("p_partkey", "p_name AS title", "p_brand AS series", "p_type AS author", "CASE WHEN p_size % 2 = 0 THEN p_size / 2 END AS issue_number", "p_size AS pages")
    return shelves.sort_shelf(rows, shelves.sorts("comics"), ("p_partkey",), "issue", False).select("p_partkey")


@query("so01_unknown_column", f"SELECT {ITEM} FROM tracks ORDER BY {ITEM}", "tracks")
def unsorted(spark, sf):
    return shelves.sort_shelf(v.tracks(spark, sf), {}, v.SHELF, "nonsense").select(*v.SHELF)


@query("sh05_album_header", "SELECT arg_min(coalesce(album_artist, artist, 'Unknown'), shelf) AS artist, count(*) AS tracks, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS playtime_ms FROM ranked_tracks WHERE coalesce(album, 'Unknown') = 'Unknown'", "ranked_tracks")
def album_header(spark, sf):
    return shelves.albums(shelves.of_album(v.tracks(spark, sf), "Unknown"), v.SHELF).select("artist", "tracks", "playtime_ms")


@query("sh08_comic_series", "SELECT coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_brand END, 'Unknown') AS series_key, count(*) AS issues FROM part GROUP BY 1")
def comic_series(spark, sf):
    rows = v.table(spark, sf, "part").selectExpr("p_partkey AS item_id", "'document' AS kind", "CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS series", "p_name AS title", "CAST(NULL AS BIGINT) AS duration_ms", "CAST(NULL AS STRING) AS album")
    return shelves.series(rows, ("item_id",)).select("series_key", F.col("episodes").alias("issues"))


@query("co01_created", """WITH known AS (SELECT DISTINCT conv_id AS collection_id, 'collection' AS name FROM conversations), made AS (SELECT DISTINCT role || ' ' || turn AS name FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL)
SELECT * FROM known UNION ALL SELECT (SELECT max(collection_id) FROM known) + row_number() OVER (ORDER BY name) AS collection_id, name FROM made""")
def created(spark, sf):
    """A collection for each role and turn, beside those that are there."""
    talk = v.table(spark, sf, "conversations")
    known = talk.select(F.col("conv_id").alias("collection_id"), F.lit("collection").alias("name")).distinct()
    return collections.create(known, talk.where("role IS NOT NULL AND turn IS NOT NULL").select(F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("name")).distinct())


@query("co01_collections", "SELECT conv_id AS collection_id, CASE WHEN conv_id % 2 = 0 THEN 'renamed' ELSE 'collection' END AS name FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 <> 0")
def listed(spark, sf):
    from ..operators import maintenance

    rows = v.entries(spark, sf).select("collection_id").distinct().withColumn("name", F.lit("collection"))
    renamed = maintenance.rename(rows, rows.where("collection_id % 2 = 0").select("collection_id", F.lit("renamed").alias("new_name")), "collection_id")
    return maintenance.cascade(rows.where("collection_id % 5 = 0"), "collection_id", {"collections": (renamed, "collection_id")})["collections"]


@query("co06_audio_run", "SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY position) - 1 AS position, item_id FROM entries WHERE item_id LIKE 'user:%'", "entries")
def audio_run(spark, sf):
    return collections.dense(v.entries(spark, sf).where("item_id LIKE 'user:%'"), "position")


@query("pl05_progress_lookup", "SELECT c_custkey AS item_id, position_ms FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, event_id DESC) AS nth FROM progress_log) p ON c_custkey = p.item_id AND nth = 1", "progress_log")
def looked_up(spark, sf):
    items = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    return plays.progress_of(items, plays.latest_progress(v.progress_log(spark, sf))).select("item_id", "position_ms")


@query("jn13_resolve", "SELECT doc_id AS item_id, path FROM inv_base WHERE doc_id % 6 <> 0 AND source <> 'src1'", "inv_base")
def resolved_paths(spark, sf):
    """Item ids of a library by its uuid to paths of files that are there, on roots that are."""
    from ..operators.scan import availability

    files = v.inv_base(spark, sf).select(F.col("doc_id").alias("item_id"), F.lit(1).alias("library_id"), "path", F.when(F.col("doc_id") % 6 == 0, 1).alias("missing_s"))
    libraries = files.select("library_id").distinct().withColumn("uuid", F.lit("u-1"))
    roots = v.table(spark, sf, "documents").select(F.concat(F.lit("/lib/"), "source").alias("root"), (F.col("source") != "src1").alias("available")).distinct()
    wanted = files.select("item_id", F.lit("u-1").alias("uuid"))
    there = wanted.join(libraries, "uuid").join(files, ["library_id", "item_id"]).where("missing_s IS NULL")
    return there.join(availability(there, roots).where("available"), "path").select("item_id", "path")


@query("pl01_recorded", "SELECT play_id, item_id, completed FROM plays UNION ALL SELECT 10000000 + event_id, user_id, false FROM events WHERE event_type = 'view'", "plays")
def recorded(spark, sf):
    new = v.table(spark, sf, "events").where("event_type = 'view'").select((F.col("event_id") + 10_000_000).alias("play_id"), F.col("user_id").alias("item_id"))
    return plays.record_plays(v.plays(spark, sf).select("play_id", "item_id", "completed"), new)


@query("dml04_removed_roots", "SELECT DISTINCT source, lang FROM documents WHERE source <> 'src1' AND lang IS NOT NULL")
def removed_roots(spark, sf):
    from ..operators.maintenance import remove_roots

    roots = v.table(spark, sf, "documents").select(F.col("source").alias("library_id"), F.col("lang").alias("path")).where("path IS NOT NULL").distinct()
    return remove_roots(roots, roots.where("library_id = 'src1'")).select(F.col("library_id").alias("source"), F.col("path").alias("lang"))


@query("qa01_json_shape", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 2)")
def json_shape(spark, sf):
    from ..operators.maintenance import bad_json

    text = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.col("doc_id").alias("year")))).when(F.col("doc_id") % 4 == 1, '{"year": "no number"}').when(F.col("doc_id") % 4 == 2, "{not json")
    return bad_json(v.table(spark, sf, "documents").select("doc_id", text.alias("metadata")), "metadata", "year long, title string").select("doc_id")

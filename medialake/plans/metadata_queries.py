"""Queries of sidecars, names, tags and tier merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as val
from ..operators import infer, merge, normalise, sidecars
from . import views as v
from .registry import query

#: Media of the new inventory, and beside them subtitles with and without a language, lyrics, and a cover in each folder.
SIDES = """, media AS (SELECT path FROM inv_new WHERE kind IN ('audio', 'video')),
sides AS (SELECT regexp_replace(path, '\\.[^./]*$', '') || '.srt' AS path FROM inv_new WHERE kind = 'video' UNION ALL SELECT regexp_replace(path, '\\.[^./]*$', '') || '.en.srt' FROM inv_new WHERE kind = 'video'
  UNION ALL SELECT regexp_replace(path, '\\.[^./]*$', '') || '.lrc' FROM inv_new WHERE kind = 'audio' UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') || '/cover.jpg' FROM inv_new)"""


def media_and_sides(spark, sf):
    inventory = v.inv_new(spark, sf)
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    video, audio = inventory.where("kind = 'video'"), inventory.where("kind = 'audio'")
    sides = video.select(F.explode(F.array(F.concat(bare, F.lit(".srt")), F.concat(bare, F.lit(".en.srt")))).alias("path")).union(audio.select(F.concat(bare, F.lit(".lrc"))))
    return inventory.where("kind IN ('audio', 'video')").select("path"), sides.union(inventory.select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/cover.jpg"))).distinct())


@query("sd01_sidecar_kinds", SIDES + " SELECT CASE WHEN path LIKE '%.lrc' THEN 'lyrics' WHEN path LIKE '%.srt' THEN 'subtitles' ELSE 'artwork' END AS kind, count(*) AS files FROM sides GROUP BY 1", "inv_new")
def sidecar_kinds(spark, sf):
    from ..functions.classify import sidecar_kind

    return media_and_sides(spark, sf)[1].groupBy(sidecar_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("files"))


@query("sd03_associate", SIDES + """, named AS (SELECT s.path AS sidecar_path, m.path AS media_path, CASE WHEN s.path LIKE '%.lrc' THEN 'lyrics' ELSE 'subtitles' END AS kind FROM sides s JOIN media m
  ON s.path NOT LIKE '%/cover.jpg' AND regexp_replace(s.path, '/[^/]*$', '') = regexp_replace(m.path, '/[^/]*$', '') AND regexp_replace(regexp_replace(s.path, '\\.[^./]*$', ''), '\\.en$', '') = regexp_replace(m.path, '\\.[^./]*$', ''))
SELECT media_path, sidecar_path, kind FROM named UNION ALL SELECT m.path, s.path, 'artwork' FROM sides s JOIN media m ON s.path = regexp_replace(m.path, '/[^/]*$', '') || '/cover.jpg'""", "inv_new")
def associated(spark, sf):
    return sidecars.associate(*media_and_sides(spark, sf))


@query("sd05_dirty_dirs", """SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM (SELECT path FROM diffed WHERE status IN ('new', 'changed')
  UNION ALL SELECT coalesce(a.path, b.path) FROM (SELECT path, modified_s FROM inv_new WHERE path LIKE '%.srt') a FULL OUTER JOIN (SELECT path, modified_s FROM inv_old WHERE path LIKE '%.srt') b ON a.path = b.path WHERE a.modified_s IS DISTINCT FROM b.modified_s) UNION SELECT '/lib/src3/en'""", "diffed", "inv_new", "inv_old")
def dirty(spark, sf):
    from .scan_queries import diffed

    only = spark.range(1).select(F.lit("/lib/src3/en").alias("dir"))
    old, new = (t(spark, sf).where("path LIKE '%.srt'").select("path", "modified_s") for t in (v.inv_old, v.inv_new))
    return sidecars.dirty_directories(diffed(spark, sf).where("status IN ('new', 'changed')"), only, old, new)


@query("sd06_refresh", SIDES + """, art AS (SELECT m.path AS media_path, s.path AS sidecar_path FROM sides s JOIN media m ON s.path = regexp_replace(m.path, '/[^/]*$', '') || '/cover.jpg')
SELECT media_path, CASE WHEN media_path LIKE '/lib/src1/%' THEN sidecar_path ELSE replace(sidecar_path, 'cover', 'folder') END AS sidecar_path, 'artwork' AS kind FROM art""", "inv_new")
def refreshed(spark, sf):
    media, sides = media_and_sides(spark, sf)
    matches = sidecars.associate(media, sides.where("path LIKE '%/cover.jpg'"))
    dirty_dirs = media.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).where("dir LIKE '/lib/src1/%'").distinct()
    return sidecars.refresh(matches.withColumn("sidecar_path", F.replace("sidecar_path", F.lit("cover"), F.lit("folder"))), matches, dirty_dirs)


@query("fn01_inference", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, '.', ' ') WHEN 1 THEN regexp_extract(path, '^/tv/([^/]*)/', 1) WHEN 2 THEN p_name END AS series,
  CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS season, CASE WHEN p_partkey % 6 < 3 THEN CAST(regexp_extract(path, '(E|3x)(\\d+)', 2) AS INTEGER) END AS episode,
  CASE WHEN p_partkey % 6 IN (3, 4) THEN CAST(regexp_extract(path, '\\((\\d{4})\\)', 1) AS INTEGER) END AS year, CASE p_partkey % 6 WHEN 1 THEN p_name WHEN 3 THEN p_name END AS title FROM filenames""", "filenames")
def inferred(spark, sf):
    rows = v.filenames(spark, sf).withColumn("title", F.lit(None).cast("string"))
    return infer.infer_from_path(rows).select("p_partkey", "series", "season", "episode", "year", "title")


@query("fn07_release_names", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 IN (1, 3) THEN p_name WHEN p_partkey % 6 = 2 THEN NULL WHEN p_partkey % 6 = 4 THEN 'movie' ELSE p_name || ' 1920x1080' END AS inferred, 'Some.Show.1080p.WEB-DL' AS tagged_title FROM filenames WHERE p_partkey % 6 IN (1, 3, 4, 5)""", "filenames")
def release_names(spark, sf):
    rows = v.filenames(spark, sf).where("p_partkey % 6 IN (1, 3, 4, 5)").withColumn("title", F.lit("Some.Show.1080p.WEB-DL"))
    return infer.infer_from_path(rows).select("p_partkey", F.col("title").alias("inferred"), "tagged_title")


@query("fn08_clean_names", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[._]', ' ', 'g'), '\s+', ' ', 'g'), '^[\s\-]+|[\s\-]+$', '', 'g') AS name FROM pages")
def clean_names(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", val.clean_name(F.col("url")).alias("name"))


@query("fn09_title_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Tagged' ELSE 'doc_' || doc_id END AS title FROM inv_base", "inv_base")
def titles(spark, sf):
    rows = v.inv_base(spark, sf).withColumn("title", F.when(F.col("doc_id") % 2 == 0, "Tagged").otherwise(""))
    return infer.with_title(rows).select("doc_id", "title")


@query("tm01_merge", """SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'tag ' || lang WHEN doc_id % 7 <> 0 THEN 'name ' || source END AS title, CASE WHEN doc_id % 4 = 0 THEN lang ELSE source END AS a, CASE WHEN doc_id % 7 <> 0 OR doc_id % 4 = 0 THEN 1 ELSE 0 END AS has_extra FROM documents""")
def tiers_merged(spark, sf):
    docs = v.table(spark, sf, "documents")
    first = docs.select(F.col("doc_id").alias("file_id"), F.lit(1).alias("tier"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tag "), "lang")).otherwise("").alias("title"), F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("a"), "lang")).alias("extra"))
    second = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("file_id"), F.lit(2).alias("tier"), F.concat(F.lit("name "), "source").alias("title"), F.create_map(F.lit("a"), "source", F.lit("b"), "lang").alias("extra"))
    merged = merge.merge_tiers(docs.select(F.col("doc_id").alias("file_id"), "source"), first.unionByName(second))
    return merged.select("file_id", "title", F.coalesce(F.try_element_at("extra", F.lit("a")), F.col("source")).alias("a"), (F.coalesce(F.size("extra"), F.lit(0)) > 0).cast("int").alias("has_extra"))


@query("tm03_artwork_once", "SELECT doc_id % 50 AS file_id, count(DISTINCT text) AS pictures FROM documents GROUP BY 1")
def artwork_once(spark, sf):
    art = v.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("file_id"), F.lit(1).alias("tier"), F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("data"))
    return merge.distinct_artwork(art).groupBy("file_id").agg(F.count("*").alias("pictures"))


@query("tg01_skeletons", "SELECT key, regexp_replace(upper(key), '[^A-Z0-9]', '', 'g') AS skeleton, count(*) AS tags FROM raw_tags GROUP BY key", "raw_tags")
def skeletons(spark, sf):
    return v.raw_tags(spark, sf).groupBy("key", val.key_skeleton(F.col("key")).alias("skeleton")).agg(F.count("*").alias("tags"))


@query("tg03_normalised", """SELECT file_id, max(CASE WHEN seq = 0 THEN value END) AS title, CASE file_id % 4 WHEN 0 THEN NULL WHEN 1 THEN trim(max(CASE WHEN seq = 5 THEN value END)) WHEN 2 THEN trim(max(CASE WHEN seq = 5 THEN value END)) ELSE max(CASE WHEN seq = 1 THEN value END) END AS artist,
  CASE WHEN file_id % 4 < 3 THEN max(CASE WHEN seq = 1 THEN value END) END AS album_artist, max(CASE WHEN seq = 2 THEN value END) AS genre, CASE WHEN file_id % 4 <> 2 THEN max(CASE WHEN seq = 3 THEN CAST(split_part(value, '/', 1) AS BIGINT) END) END AS track_number,
  CAST(CASE WHEN file_id % 4 <> 2 THEN 50 END AS BIGINT) AS track_total, CASE WHEN file_id % 4 = 2 THEN max(CASE WHEN seq = 3 THEN CAST(split_part(value, '/', 1) AS BIGINT) END) END AS bpm, CAST(1 AS BIGINT) AS extras, '"' || max(CASE WHEN seq = 4 THEN value END) || '"' AS price FROM raw_tags GROUP BY file_id""", "raw_tags")
def normalised(spark, sf):
    rows = normalise.normalise_tags(v.raw_tags(spark, sf))
    return rows.select("file_id", "title", "artist", "album_artist", F.get("genres", 0).alias("genre"), "track_number", "track_total", "bpm", F.size("extra").cast("long").alias("extras"), F.get(F.map_values("extra"), 0).alias("price"))


@query("tg08_text_chunks", """SELECT p_partkey, p_name AS title, p_brand AS artist, 'note' AS comment, CASE WHEN p_partkey % 2 = 1 THEN p_type END AS album, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS BIGINT) END AS track_number, CASE WHEN p_partkey % 2 = 0 THEN '(c) ' ELSE 'ICOP' END AS rest, p_type AS owner FROM part""")
def text_chunks(spark, sf):
    part = v.table(spark, sf, "part")
    chunk = lambda seq, key, value: F.struct(F.lit(seq).alias("seq"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    aiff = F.array(chunk(0, "NAME", F.col("p_name")), chunk(1, "AUTH", F.col("p_brand")), chunk(2, "ANNO", F.lit("note")), chunk(3, "COMT", F.lit("later")), chunk(4, "(c) ", F.col("p_type")))
    riff = F.array(chunk(0, "INAM", F.col("p_name")), chunk(1, "IART", F.col("p_brand")), chunk(2, "ICMT", F.lit("note")), chunk(3, "IPRD", F.col("p_type")), chunk(4, "IPRT", F.col("p_size")), chunk(5, "ICOP", F.col("p_type")))
    even = F.col("p_partkey") % 2 == 0
    rows = part.select(F.col("p_partkey").alias("file_id"), F.when(even, "aiff").otherwise("riff").alias("dialect"), F.inline(F.when(even, aiff).otherwise(riff)))
    out = normalise.normalise_tags(rows)
    return out.select(F.col("file_id").alias("p_partkey"), "title", "artist", "comment", "album", "track_number", F.get(F.map_keys("extra"), 0).alias("rest"), F.regexp_replace(F.get(F.map_values("extra"), 0), '"', "").alias("owner"))


@query("tg22_matroska", """SELECT p_partkey, p_name AS title, 1990 + p_size AS year, p_type AS genre, CASE WHEN p_partkey % 3 = 0 THEN concat('by ', p_brand) END AS artist, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS album, CASE WHEN p_partkey % 3 = 0 THEN concat('mood ', p_type) END AS mood,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Album,Mood,artist' END AS rest FROM part""")
def matroska_tags(spark, sf):
    part = v.table(spark, sf, "part")
    named = {"Title": F.col("p_name"), "artist": F.concat(F.lit("by "), "p_brand"), "Album": F.col("p_brand"), "GENRE": F.col("p_type"), "Mood": F.concat(F.lit("mood "), "p_type")}
    tags = [F.struct(F.lit(i).alias("seq"), F.lit(k).alias("key"), c.alias("value")) for i, (k, c) in enumerate(named.items())]
    tags.append(F.struct(F.lit(9).alias("seq"), F.lit("DATE_RELEASED").alias("key"), F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-05-01")).alias("value")))
    rows = part.select(F.col("p_partkey").alias("file_id"), F.lit("matroska").alias("dialect"), F.when(F.col("p_partkey") % 3 == 0, "audio").otherwise("video").alias("kind"), F.inline(F.array(*tags)))
    rest = F.array_join(F.array_sort(F.map_keys("extra")), ",")
    return normalise.normalise_tags(rows).select(F.col("file_id").alias("p_partkey"), "title", "year", F.get("genres", 0).alias("genre"), "artist", "album", "mood", rest.alias("rest"))


@query("tg09_pairs", "SELECT file_id, CAST(split_part(value, '/', 1) AS BIGINT) AS number, CAST(50 AS BIGINT) AS total FROM raw_tags WHERE seq = 3", "raw_tags")
def pairs(spark, sf):
    number, total = val.pair(F.col("value"))
    return v.raw_tags(spark, sf).where("seq = 3").select("file_id", number.alias("number"), total.alias("total"))


@query("tg11_decibels", "SELECT p_partkey, -p_size / 10.0::DOUBLE AS gain, p_size * 2.0::DOUBLE AS peak FROM part")
def gains(spark, sf):
    text = F.concat(F.lit(" −"), (F.col("p_size") / 10).cast("string"), F.lit(" dB"))
    return v.table(spark, sf, "part").select("p_partkey", val.decibels(text).alias("gain"), val.number((F.col("p_size") * 2).cast("string")).alias("peak"))


@query("tg12_years", "SELECT o_orderkey, YEAR(o_orderdate)::INTEGER AS year, o_orderkey % 3 = 0 AS compilation FROM orders")
def years(spark, sf):
    flags = F.get(F.array(F.lit(" Yes "), F.lit("0"), F.lit("no")), (F.col("o_orderkey") % 3).cast("int"))
    return v.table(spark, sf, "orders").select("o_orderkey", val.year_like(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"), val.flag(flags).alias("compilation"))


@query("tg14_ratings", "SELECT p_partkey, round(least(p_size * 8, 255) * 100 / 255.0)::INTEGER AS rating FROM part")
def ratings(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", val.rating(F.col("p_size") * 8).alias("rating"))


@query("tg15_calendar", "SELECT o_orderkey, CASE WHEN MONTH(o_orderdate) = 1 AND DAY(o_orderdate) = 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN MONTH(o_orderdate) = 1 AND DAY(o_orderdate) = 1 THEN YEAR(o_orderdate)::INTEGER END AS year FROM orders")
def calendars(spark, sf):
    date, year = val.calendar(F.col("o_orderdate"))
    return v.table(spark, sf, "orders").select("o_orderkey", date.alias("date"), year.alias("year"))


@query("tg16_names", "SELECT p_partkey, p_name || '|' || p_brand AS names FROM part")
def names(spark, sf):
    listed = val.distinct_names(F.array("p_name", F.lit(" "), F.concat(F.lit(" "), "p_brand"), "p_name", F.lit(None).cast("string")))
    return v.table(spark, sf, "part").select("p_partkey", F.array_join(listed, "|").alias("names"))


@query("tg17_kbps", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN round((l_quantity - 25) * 17)::BIGINT END AS kbps FROM lineitem")
def bit_rates(spark, sf):
    return v.table(spark, sf, "lineitem").select(*v.SHELF, val.kbps((F.col("l_quantity") - 25) * 17000).alias("kbps"))


@query("im01_exif_times", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS taken FROM events")
def exif_times(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy:'13':dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return v.table(spark, sf, "events").select("event_id", val.exif_time(text).alias("taken"))


@query("im02_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity / (l_suppkey % 5) END AS ratio FROM lineitem")
def ratios(spark, sf):
    return v.table(spark, sf, "lineitem").select(*v.SHELF, val.ratio(F.col("l_quantity"), F.col("l_suppkey") % 5).alias("ratio"))


@query("im03_degrees", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN -1 ELSE 1 END * round(l_quantity + l_linenumber / 60.0::DOUBLE + 30 / 3600.0::DOUBLE, 9) AS latitude, CASE WHEN l_linenumber = 1 THEN -l_quantity ELSE l_quantity END AS altitude FROM lineitem")
def coordinates(spark, sf):
    side = F.when(F.col("l_suppkey") % 2 == 0, "south").otherwise("N")
    return v.table(spark, sf, "lineitem").select(*v.SHELF, F.round(val.degrees(F.col("l_quantity"), F.col("l_linenumber"), F.lit(30), side, "S"), 9).alias("latitude"), val.altitude(F.col("l_quantity"), F.col("l_linenumber")).alias("altitude"))


@query("im05_exif_extra", "SELECT file_id, CAST(count(*) AS INTEGER) AS extras FROM raw_tags WHERE seq NOT IN (0, 5) AND NOT (file_id % 4 = 3 AND seq = 0) GROUP BY file_id", "raw_tags")
def exif_rest(spark, sf):
    tags = v.raw_tags(spark, sf).withColumn("key", F.concat("key", F.col("seq").cast("string")))
    typed = ["title0", "TIT20", "©nam0", "INAM0", "TITLE5", "TPE15", "©ART5", "INAM5"]
    return normalise.exif_extra(tags, typed).select("file_id", F.size("extra").alias("extras"))


@query("dc01_isbn", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '9') WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '1') || 'X' END AS isbn FROM part")
def isbns(spark, sf):
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("urn:ISBN:"), F.lpad(key, 13, "9"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("isbn: "), F.lpad(key, 9, "1"), F.lit("-x"))).otherwise(key)
    return v.table(spark, sf, "part").select("p_partkey", val.isbn(text).alias("isbn"))


@query("dc02_pdf_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M') || '+02:00' END AS date FROM orders")
def pdf_dates(spark, sf):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyyMMdd")).otherwise(F.concat(F.date_format(d, "yyyyMMddHHmm"), F.lit("+02'00'")))
    return v.table(spark, sf, "orders").select("o_orderkey", val.pdf_date(F.concat(F.lit("D:"), text)).alias("date"))


@query("dc03_comics", "SELECT p_partkey, p_name AS title, p_brand AS series, p_size / 2.0::DOUBLE AS issue_number, p_size AS page_count FROM part")
def comics(spark, sf):
    xml = F.concat(F.lit("<ComicInfo><Title>"), "p_name", F.lit("</Title><Series>"), "p_brand", F.lit("</Series><Number>"), (F.col("p_size") / 2).cast("string"), F.lit("</Number><PageCount>"), F.col("p_size").cast("string"), F.lit("</PageCount></ComicInfo>"))
    return v.table(spark, sf, "part").select("p_partkey", normalise.comic_info(xml).alias("c")).select("p_partkey", "c.title", "c.series", "c.issue_number", "c.page_count")


@query("dc04_comic_pages", "SELECT p_size AS file_id, min(p_name || '.jpg') AS cover, count(*) AS pages FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_size")
def pages_of_comics(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, ".xml").otherwise(".jpg"))
    return normalise.comic_pages(v.table(spark, sf, "part").select(F.col("p_size").alias("file_id"), name.alias("name")))


@query("vc01_codecs", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'xyz' WHEN 2 THEN 'aac' ELSE 'opus' END AS iso_or_matroska, CASE WHEN p_size IN (1, 3) THEN 'pcm' ELSE 'wave-0x' || lower(printf('%04x', p_size)) END AS wave FROM part""")
def codecs(spark, sf):
    at = (F.col("p_partkey") % 4).cast("int")
    iso = normalise.codec_name("iso_video", F.get(F.array(F.lit("avc1"), F.lit("xyz ")), at))
    mkv = normalise.codec_name("matroska", F.get(F.array(F.lit(""), F.lit(""), F.lit("A_AAC/MPEG4"), F.lit("A_OPUS")), at))
    wave = normalise.codec_name("wave", F.col("p_size"))
    return v.table(spark, sf, "part").select("p_partkey", F.when(at < 2, iso).otherwise(mkv).alias("iso_or_matroska"), wave.alias("wave"))


@query("sd02_folder_art", "SELECT doc_id, doc_id % 4 IN (0, 1) AS art FROM documents")
def folder_art_names(spark, sf):
    from ..functions.classify import is_folder_art

    names = F.get(F.array(F.lit("/a/Cover.JPG"), F.lit("/a/fanart.webp"), F.lit("/a/cover.gif"), F.lit("/a/covers.png")), (F.col("doc_id") % 4).cast("int"))
    return v.table(spark, sf, "documents").select("doc_id", is_folder_art(names).alias("art"))


@query("sd04_fan_out", "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS served FROM inv_new WHERE kind IN ('audio', 'video') GROUP BY 1", "inv_new")
def fan_out(spark, sf):
    media, sides = media_and_sides(spark, sf)
    art = sidecars.associate(media, sides.where("path LIKE '%/cover.jpg'"))
    return art.groupBy(F.regexp_replace("media_path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("served"))

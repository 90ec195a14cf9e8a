"""Tags of several dialects into typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as val
from .shelves import artist_shown

#: Fields and the key skeletons that mean them, in every dialect that spells keys out.
SPELLED = {
    "recording_id": ("MUSICBRAINZTRACKID", "MUSICBRAINZRECORDINGID"), "track_id": ("MUSICBRAINZRELEASETRACKID",), "release_id": ("MUSICBRAINZALBUMID", "MUSICBRAINZRELEASEID"), "release_group_id": ("MUSICBRAINZRELEASEGROUPID",),
    "artist_id": ("MUSICBRAINZARTISTID",), "album_artist_id": ("MUSICBRAINZALBUMARTISTID",), "work_id": ("MUSICBRAINZWORKID",), "acoust_id": ("ACOUSTIDID",),
    "track_gain": ("REPLAYGAINTRACKGAIN",), "track_peak": ("REPLAYGAINTRACKPEAK",), "album_gain": ("REPLAYGAINALBUMGAIN",), "album_peak": ("REPLAYGAINALBUMPEAK",),
    "album_artist": ("ALBUMARTIST", "BAND"), "sort_title": ("TITLESORT", "SORTTITLE", "TITLESORTORDER"), "sort_artist": ("ARTISTSORT", "SORTARTIST", "ARTISTSORTORDER"), "sort_album": ("ALBUMSORT", "SORTALBUM", "ALBUMSORTORDER"),
    "sort_album_artist": ("ALBUMARTISTSORT", "SORTALBUMARTIST", "ALBUMARTISTSORTORDER"), "conductor": ("CONDUCTOR",), "remixer": ("REMIXER", "MIXARTIST"), "grouping": ("GROUPING", "CONTENTGROUP"), "language": ("LANGUAGE",), "isrc": ("ISRC",),
    "barcode": ("BARCODE",), "catalog_number": ("CATALOGNUMBER", "CATALOGUENUMBER", "LABELNO"), "label": ("LABEL", "ORGANIZATION", "PUBLISHER"), "media": ("MEDIA",), "mood": ("MOOD",), "bpm": ("BPM",),
    "original_year": ("ORIGINALYEAR", "ORIGINALDATE"), "compilation": ("COMPILATION", "ITUNESCOMPILATION"), "date": ("DATE", "YEAR"), "title": ("TITLE",), "artist": ("ARTIST",), "album": ("ALBUM",), "genres": ("GENRE",),
    "composers": ("COMPOSER",), "lyricists": ("LYRICIST",), "comment": ("COMMENT", "DESCRIPTION"), "lyrics": ("LYRICS", "UNSYNCEDLYRICS"), "initial_key": ("INITIALKEY", "KEY"), "encoder": ("ENCODER", "ENCODEDBY"),
    "track": ("TRACKNUMBER", "TRACK"), "disc": ("DISCNUMBER", "DISC"), "track_total": ("TRACKTOTAL", "TOTALTRACKS"), "disc_total": ("DISCTOTAL", "TOTALDISCS"),
}

#: Fields and their keys in the dialects with codes for keys.
CODED = {
    "id3v2": {
        "title": ("TIT2",), "album": ("TALB",), "artist": ("TPE1",), "album_artist": ("TPE2",), "conductor": ("TPE3",), "remixer": ("TPE4",), "grouping": ("TIT1", "GRP1"), "composers": ("TCOM",), "lyricists": ("TEXT",), "genres": ("TCON",),
        "track": ("TRCK",), "disc": ("TPOS",), "bpm": ("TBPM",), "initial_key": ("TKEY",), "language": ("TLAN",), "media": ("TMED",), "mood": ("TMOO",), "isrc": ("TSRC",), "label": ("TPUB",), "encoder": ("TENC", "TSSE"), "sort_title": ("TSOT",),
        "sort_artist": ("TSOP",), "sort_album": ("TSOA",), "sort_album_artist": ("TSO2",), "compilation": ("TCMP",), "date": ("TDRC", "TYER"), "original_year": ("TDOR", "TORY"), "comment": ("COMM",), "lyrics": ("USLT",), "rating": ("POPM",),
    },
    "id3v1": {"title": ("title",), "artist": ("artist",), "album": ("album",), "date": ("year",), "comment": ("comment",), "track": ("track",), "genres": ("genre",)},
    "ilst": {
        "title": ("©nam",), "date": ("©day",), "genres": ("©gen", "gnre"), "comment": ("©cmt", "desc"), "artist": ("©ART",), "album_artist": ("aART",), "album": ("©alb",), "composers": ("©wrt",), "lyrics": ("©lyr",), "grouping": ("©grp",),
        "encoder": ("©too",), "bpm": ("tmpo",), "compilation": ("cpil",), "sort_title": ("sonm",), "sort_artist": ("soar",), "sort_album": ("soal",), "sort_album_artist": ("soaa",), "track": ("trkn",), "disc": ("disk",),
        "series": ("tvsh",), "season": ("tvsn",), "episode": ("tves",),
    },
    "riff": {"title": ("INAM",), "artist": ("IART",), "album": ("IPRD",), "genres": ("IGNR",), "date": ("ICRD",), "comment": ("ICMT",), "encoder": ("ISFT",), "track": ("ITRK", "IPRT")},
    "aiff": {"title": ("NAME",), "artist": ("AUTH",), "comment": ("ANNO", "COMT")},
    "matroska video": {"title": ("TITLE",), "date": ("DATE_RELEASED", "DATE"), "genres": ("GENRE",), "comment": ("COMMENT", "DESCRIPTION")},
}

LISTS = ("artists", "genres", "composers", "lyricists")
#: Typed and kept among the rest as well: identifiers are too precious to be only paraphrased.
TWICE = ("recording_id", "track_id", "release_id", "release_group_id", "artist_id", "album_artist_id", "work_id", "acoust_id", "track_gain", "track_peak", "album_gain", "album_peak")
GAINS, PEAKS = ("track_gain", "album_gain"), ("track_peak", "album_peak")
INTEGERS = ("bpm", "track_total", "disc_total", "season", "episode")


def aliases(spark: SparkSession) -> DataFrame:
    """dialect, alias, field: a few hundred rows, fixed."""
    rows = [(d, k, field) for d in ("vorbis", "ape", "wma", "matroska") for field, keys in SPELLED.items() for k in keys]
    rows += [(d, k, field) for d, fields in CODED.items() for field, keys in fields.items() for k in keys]
    rows.append(("matroska", "DATERELEASED", "date"))
    # descriptions of user frames and names of freeform atoms are spelled out
    rows += [(d, f"*{k}", field) for d in ("id3v2", "ilst") for field, keys in SPELLED.items() for k in keys]
    return spark.createDataFrame(rows, "dialect string, alias string, field string")


def skeleton(dialect: Column, key: Column) -> Column:
    free = F.when((dialect == "id3v2") & key.startswith("TXXX:"), F.substring(key, 6, 10_000)).when((dialect == "ilst") & key.startswith("----:"), F.substring_index(key, ":", -1))
    return F.when(free.isNotNull(), F.concat(F.lit("*"), val.key_skeleton(free))).when(dialect.isin("vorbis", "ape", "wma", "matroska"), val.key_skeleton(key)).when(dialect == "matroska video", F.upper(key)).otherwise(key)


def with_fields(raw_tags: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """raw_tags(file_id, dialect, seq, key, value) with field, null where no alias claims the key, and the clean value; blank values go.

    With a column kind, Matroska tags of a video have few fields: an artist or album of one stays among the rest.
    """
    table = table or aliases(raw_tags.sparkSession)
    shape = F.when((F.col("dialect") == "matroska") & (F.col("kind") == "video"), "matroska video").otherwise(F.col("dialect")) if "kind" in raw_tags.columns else F.col("dialect")
    rows = raw_tags.withColumn("shape", shape).withColumn("alias", skeleton(F.col("shape"), F.col("key")))
    rows = rows.join(F.broadcast(table.withColumnRenamed("dialect", "shape")), ["shape", "alias"], "left").drop("shape", "alias")
    return rows.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where("value <> '' AND value <> '\0'")


#: Fixed value: the frame of the original artist.
ORIGINAL_ARTIST = "TOPE"


def normalise_tags(raw_tags: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row a file: typed fields, lists and the rest as a map of JSON texts. The first value of a field stands; ID3v1 only fills silence.

    Several values behind NULs are taken apart: the first is the one shown, lists get all. An ID3v2 file without a lead performer shows its band, else its original artist.
    """
    rows = with_fields(raw_tags, table).withColumn("at", F.struct((F.col("dialect") == "id3v1").cast("int").alias("late"), F.col("seq").alias("seq")))
    shown = val.clean_value(F.split_part("value", F.lit("\0"), F.lit(1)))
    rows = rows.withColumn("shown", F.when(F.col("dialect") == "id3v2", shown).otherwise(val.clean_value(F.col("value"))))
    of = lambda field, c="shown": F.min_by(F.when(F.col("field") == field, F.col(c)), F.when((F.col("field") == field) & F.col(c).isNotNull(), F.col("at")))
    every = lambda field: val.distinct_names(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("at", F.split("value", "\0").alias("values"))))), lambda x: x["values"])))
    kept = F.when(F.col("field").isNull() | F.col("field").isin(*TWICE), F.struct("key", "at", "value"))
    fields = sorted({*SPELLED, *CODED["id3v2"], *CODED["ilst"]} - set(LISTS))
    out = rows.groupBy("file_id").agg(*[of(f).alias(f) for f in fields], *[every("artist" if f == "artists" else f).alias(f) for f in LISTS], F.array_sort(F.collect_list(kept)).alias("kept"), F.max((F.col("dialect") == "id3v2").cast("int")).alias("id3"))
    track, track_total = val.pair(F.col("track"))
    disc, disc_total = val.pair(F.col("disc"))
    names = F.array_distinct(F.transform("kept", lambda x: x["key"]))
    texts = lambda k: F.transform(F.filter("kept", lambda x: x["key"] == k), lambda x: x["value"])
    extra = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.when(F.size(texts(k)) == 1, F.to_json(F.struct(F.get(texts(k), 0).alias("v")))).otherwise(F.to_json(F.struct(texts(k).alias("v")))).alias("value"))))
    original = F.get(F.filter("kept", lambda x: x["key"] == ORIGINAL_ARTIST), 0)["value"]
    return out.withColumns({
        "artist": F.when(F.col("id3") == 1, artist_shown(F.col("artist"), F.col("album_artist"), original)).otherwise(F.col("artist")), "extra": F.transform_values(extra, lambda _, t: F.regexp_extract(t, r'^\{"v":(.*)\}$', 1)),
        "track_number": track, "track_total": F.coalesce(track_total, val.leading_int(F.col("track_total"))), "disc_number": disc, "disc_total": F.coalesce(disc_total, val.leading_int(F.col("disc_total"))),
        "bpm": F.round(val.found(F.col("bpm"), r"^\s*(\d+(?:\.\d+)?)", 1).cast("double")).cast("long"), **{c: val.leading_int(F.col(c)) for c in ("season", "episode")}, **{c: val.decibels(F.col(c)) for c in GAINS}, **{c: val.number(F.col(c)) for c in PEAKS},
        "original_year": val.year_like(F.col("original_year")), "compilation": val.flag(F.col("compilation")), "rating": F.when(val.leading_int(F.col("rating")) > 0, val.rating(val.leading_int(F.col("rating")))),
        "artists": F.when(F.size("artists") > 1, F.col("artists")), "year": val.found(F.col("date"), r"^(\d{4})", 1).cast("int"),
    }).drop("kept", "track", "disc", "id3")


def exif_extra(tags: DataFrame, typed: list[str], longest: int = 160, most: int = 128) -> DataFrame:
    """file_id, extra from tags(file_id, seq, key, value): what is not typed, values cut to `longest` characters, the first `most` in order."""
    rest = tags.where(~F.col("key").isin(*typed)).withColumn("nth", F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))).where(F.col("nth") <= most)
    return rest.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.substring("value", 1, longest)))).alias("extra"))


#: Friendly names of codecs.
ISO_VIDEO = {"avc1": "h264", "avc3": "h264", "hvc1": "h265", "hev1": "h265", "vp08": "vp8", "vp09": "vp9", "av01": "av1", "mp4v": "mpeg4"}
ISO_AUDIO = {"mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "Opus": "opus", "fLaC": "flac", "alac": "alac", "sowt": "pcm", "twos": "pcm", "lpcm": "pcm", ".mp3": "mp3"}
MATROSKA = {"V_MPEG4/ISO/AVC": "h264", "V_MPEGH/ISO/HEVC": "h265", "V_VP8": "vp8", "V_VP9": "vp9", "V_AV1": "av1", "V_THEORA": "theora", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_MPEG/L3": "mp3", "A_MPEG/L2": "mp2", "A_EAC3": "eac3", "A_TRUEHD": "truehd"}
MATROSKA_STARTS = {"A_AAC": "aac", "A_AC3": "ac3", "A_DTS": "dts", "A_PCM": "pcm", "V_MPEG4/ISO": "mpeg4", "V_MPEG2": "mpeg2"}
RIFF = {"MJPG": "mjpeg", "H264": "h264", "X264": "h264", "AVC1": "h264", "H265": "h265", "HEVC": "h265", "HVC1": "h265", "XVID": "mpeg4", "DIVX": "mpeg4", "DX50": "mpeg4", "FMP4": "mpeg4", "MP4V": "mpeg4", "VP80": "vp8", "VP90": "vp9", "AV01": "av1"}
WAVE = {0x0001: "pcm", 0x0003: "pcm", 0x0050: "mp2", 0x0055: "mp3", 0x00FF: "aac", 0x2000: "ac3", 0x2001: "dts", 0x0160: "wmav1", 0x0161: "wmav2"}


def codec_name(family: str, code: Column) -> Column:
    """family: iso_video, iso_audio, matroska, riff, or wave (a number)."""
    from ..functions.classify import looked_up

    if family == "wave":
        return F.coalesce(looked_up(code.cast("string"), {str(k): n for k, n in WAVE.items()}), F.concat(F.lit("wave-0x"), F.lower(F.lpad(F.hex(code), 4, "0"))))
    if family == "matroska":
        start = F.coalesce(*[F.when(code.startswith(p), n) for p, n in MATROSKA_STARTS.items()])
        return F.coalesce(looked_up(code, MATROSKA), start, code)
    table = {"iso_video": ISO_VIDEO, "iso_audio": ISO_AUDIO, "riff": RIFF}[family]
    return F.coalesce(looked_up(F.upper(code) if family == "riff" else code, table), F.trim(code))


COMIC = "struct<Title:string,Series:string,Number:double,Writer:string,Publisher:string,LanguageISO:string,Summary:string,PageCount:int>"


def comic_info(xml: Column) -> Column:
    """title, series, issue_number, author, publisher, language, description, page_count of a comic's description."""
    c = F.from_xml(xml, F.lit(COMIC.replace("struct<", "").rstrip(">").replace(":", " ")))
    return F.struct(c["Title"].alias("title"), c["Series"].alias("series"), c["Number"].alias("issue_number"), c["Writer"].alias("author"), c["Publisher"].alias("publisher"), c["LanguageISO"].alias("language"), c["Summary"].alias("description"), c["PageCount"].alias("page_count"))


def comic_pages(entries: DataFrame) -> DataFrame:
    """file_id, cover, pages of entries(file_id, name): images only, the cover first in order of name."""
    from ..functions.classify import kind_by_extension

    return entries.where(kind_by_extension(F.col("name")) == "image").groupBy("file_id").agg(F.min("name").alias("cover"), F.count(F.lit(1)).alias("pages"))

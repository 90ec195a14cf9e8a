"""The metadata of each kind as JSON: its names, types, reading and writing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and types of each kind's metadata, as stored.
SCHEMAS = {
    "audio": """title STRING, artist STRING, album STRING, albumArtist STRING, sortTitle STRING, sortArtist STRING, sortAlbum STRING, sortAlbumArtist STRING, conductor STRING, remixer STRING, grouping STRING, comment STRING, lyrics STRING, language STRING,
        initialKey STRING, isrc STRING, barcode STRING, catalogNumber STRING, label STRING, encoder STRING, media STRING, mood STRING, codec STRING, date STRING, acoustId STRING, year INT, trackNumber INT, trackTotal INT, discNumber INT, discTotal INT,
        bitrateKbps INT, bpm INT, sampleRateHz INT, channels INT, bitsPerSample INT, originalYear INT, rating INT, durationMs BIGINT, compilation BOOLEAN, lossless BOOLEAN, artists ARRAY<STRING>, composers ARRAY<STRING>, lyricists ARRAY<STRING>, genres ARRAY<STRING>,
        chapters ARRAY<STRUCT<title: STRING, startMs: BIGINT>>, musicBrainz STRUCT<recordingId: STRING, trackId: STRING, releaseId: STRING, releaseGroupId: STRING, artistId: STRING, albumArtistId: STRING, workId: STRING>,
        replayGain STRUCT<trackGain: DOUBLE, trackPeak: DOUBLE, albumGain: DOUBLE, albumPeak: DOUBLE>, extra MAP<STRING, STRING>""",
    "video": """title STRING, year INT, durationMs BIGINT, series STRING, season INT, episode INT, width INT, height INT, frameRate DOUBLE, videoCodec STRING, audioCodec STRING, container STRING, date STRING, genres ARRAY<STRING>, comment STRING,
        subtitleLanguages ARRAY<STRING>, chapters ARRAY<STRUCT<title: STRING, startMs: BIGINT>>, extra MAP<STRING, STRING>""",
    "image": """title STRING, takenAt STRING, width INT, height INT, cameraMake STRING, cameraModel STRING, lensModel STRING, orientation INT, iso INT, exposureSeconds DOUBLE, fNumber DOUBLE, focalLengthMm DOUBLE, gpsLatitude DOUBLE, gpsLongitude DOUBLE,
        gpsAltitude DOUBLE, description STRING, extra MAP<STRING, STRING>""",
    "document": "title STRING, author STRING, authors ARRAY<STRING>, language STRING, publisher STRING, isbn STRING, description STRING, pageCount INT, series STRING, issueNumber DOUBLE, extra MAP<STRING, STRING>",
}


def decode(metadata: Column, kind: str) -> Column:
    """The struct of a kind; values of a wrong type are null, absent fields too."""
    return F.from_json(metadata, SCHEMAS[kind])


def encode(struct: Column, kind: str) -> Column:
    """JSON without nulls, empty lists and empty maps."""
    from pyspark.sql.types import ArrayType, MapType, StructType, _parse_datatype_string

    fields = _parse_datatype_string(SCHEMAS[kind]).fields
    value = lambda f: F.when(F.size(struct[f.name]) > 0, struct[f.name]) if isinstance(f.dataType, (ArrayType, MapType)) else struct[f.name]
    shown = [F.when(F.coalesce(*[struct[f.name][g.name].cast("string") for g in f.dataType.fields]).isNotNull(), struct[f.name]).alias(f.name) if isinstance(f.dataType, StructType) else value(f).alias(f.name) for f in fields]
    return F.to_json(F.struct(*shown))


def year_of(audio: Column) -> Column:
    """The stored year, else the date's."""
    return F.coalesce(audio["year"], F.nullif(F.regexp_extract(audio["date"], r"^\d{4}", 0), F.lit("")).cast("int"))

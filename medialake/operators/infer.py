"""Series, season, episode, year and title from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, stem
from ..functions.values import blank_to_null, clean_name, found

#: The shapes of names.
SEASON_EPISODE = r"(?<![A-Za-z0-9])[Ss](\d{1,2})\s?[Ee](\d{1,3})"
CROSS_FORM = r"(?<!\d)(\d{1,2})x(\d{2,3})(?!\d)"
TITLE_YEAR = r"^(.+?)[\s._]*\((\d{4})\)$"
SEASON_DIR = r"(?i)^(s(eason)?[\s._-]*\d+|specials?)$"
RELEASE_NOISE = r"(?i)\b(2160p|1080p|720p|480p|WEB-?DL|WEB-?Rip|Blu-?Ray|BRRip|HDTV|x26[45]|H\.?26[45]|HEVC|DDP?[257]|AC3|AAC2?|10bit|AMZN|RARBG|YIFY|YTS)\b"
DOTTED_RUN = r"\w\.\w+\.\w"


def is_release_name(title: Column) -> Column:
    return title.rlike(RELEASE_NOISE) | ((title.rlike(SEASON_EPISODE) | title.rlike(CROSS_FORM)) & title.rlike(DOTTED_RUN))


def infer_from_path(df: DataFrame, path: str = "path", title: str = "title") -> DataFrame:
    """df with series, season, episode, year, title and tagged_title filled from the path where df has no such column or a null in it.

    A title that is a release name steps down, is kept as tagged_title, and the name speaks instead.
    """
    given = {c: (F.col(c) if c in df.columns else F.lit(None).cast(t)) for c, t in (("series", "string"), ("season", "int"), ("episode", "int"), ("year", "int"), (title, "string"))}
    base, where = stem(F.col(path)), dirname(F.col(path))
    first, second = base.rlike(SEASON_EPISODE), base.rlike(CROSS_FORM)
    shape = lambda i: F.when(first, found(base, SEASON_EPISODE, i)).when(second, found(base, CROSS_FORM, i))
    episodic = first | second
    mark = shape(0)
    at = F.instr(base, mark)
    before = clean_name(F.substring(base, F.lit(1), at - 1))
    after = blank_to_null(clean_name(F.substring(base, at + F.length(mark), F.length(base))))
    prefix = F.coalesce(F.when(before.rlike(TITLE_YEAR), clean_name(F.regexp_extract(before, TITLE_YEAR, 1))), before)
    parts = F.filter(F.reverse(F.split(where, "/")), lambda p: (p != "") & (p != ".") & ~F.trim(p).rlike(SEASON_DIR))
    shelf = F.get(parts, 0)
    shelf_name = blank_to_null(clean_name(F.coalesce(found(shelf, TITLE_YEAR, 1), shelf)))
    from_dir = prefix == ""
    series = F.coalesce(given["series"], F.when(episodic, F.when(from_dir, shelf_name).otherwise(prefix)))
    own_year, dir_year = found(before, TITLE_YEAR, 2), F.when(from_dir, found(shelf, TITLE_YEAR, 2))
    episode_year = F.when(given["series"].isNull(), F.coalesce(own_year, dir_year))
    year = F.when(episodic, episode_year).otherwise(F.coalesce(found(base, TITLE_YEAR, 2), found(basename(where), TITLE_YEAR, 2)))

    said = blank_to_null(given[title])
    noisy = F.coalesce(is_release_name(said), F.lit(False))
    kept = F.when(~noisy, said)
    inferred = F.when(episodic, after).otherwise(blank_to_null(clean_name(F.regexp_extract(base, TITLE_YEAR, 1))))
    told = F.coalesce(kept, inferred, F.when(noisy, blank_to_null(clean_name(base))))
    return df.withColumns({
        "series": series, "season": F.coalesce(given["season"], F.when(episodic, shape(1).cast("int"))), "episode": F.coalesce(given["episode"], F.when(episodic, shape(2).cast("int"))),
        "year": F.coalesce(given["year"], year.cast("int")), title: told, "tagged_title": F.when(noisy, said),
    })


def with_title(df: DataFrame, path: str = "path", title: str = "title") -> DataFrame:
    """The stem where nothing gave a title."""
    return df.withColumn(title, F.coalesce(blank_to_null(F.col(title)), stem(F.col(path))))

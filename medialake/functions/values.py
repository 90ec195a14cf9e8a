"""Cleaning and reading of tag values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern's first match; null where nothing matches."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def key_skeleton(key: Column) -> Column:
    return F.regexp_replace(F.upper(key), "[^A-Z0-9]", "")


def clean_value(value: Column) -> Column:
    """Without NULs and outer white space; null if nothing is left."""
    return blank_to_null(F.regexp_replace(F.replace(value, F.lit("\0"), F.lit("")), r"^\s+|\s+$", ""))


def clean_name(name: Column) -> Column:
    """Dots and underscores become spaces, runs of space one, and spaces and dashes fall off the ends."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[._]", " "), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[\s\-]+|[\s\-]+$", "")


def leading_int(value: Column) -> Column:
    return found(F.trim(value), r"^(\d{1,18})", 1).cast("long")


def number(value: Column) -> Column:
    return clean_value(value).try_cast("double")


def pair(value: Column) -> tuple[Column, Column]:
    """`3/8` into number and total."""
    return leading_int(F.split_part(value, F.lit("/"), F.lit(1))), leading_int(F.when(value.contains("/"), F.substring_index(value, "/", -1)))


def decibels(value: Column) -> Column:
    text = F.replace(clean_value(value), F.lit("−"), F.lit("-"))
    return F.trim(F.regexp_replace(text, "(?i)db$", "")).try_cast("double")


def year_like(value: Column) -> Column:
    year = found(value, r"^(\d{4})", 1).cast("int")
    return F.when(year >= 1000, year)


def flag(value: Column) -> Column:
    return F.lower(clean_value(value)).isin("1", "true", "yes")


def rating(raw: Column) -> Column:
    """0 to 255 as 0 to 100."""
    return F.round(F.greatest(F.lit(0), F.least(F.lit(255), raw)) * 100 / 255).cast("int")


def calendar(day: Column) -> tuple[Column, Column]:
    """A date text and a year: the first of January speaks of a year only; year 0 of nothing."""
    first = (F.month(day) == 1) & (F.dayofmonth(day) == 1)
    some = F.year(day) != 0
    return F.when(some & ~first, F.date_format(day, "yyyy-MM-dd")), F.when(some & first, F.year(day))


def kbps(bits_per_second: Column) -> Column:
    return F.when(bits_per_second > 0, F.round(bits_per_second / 1000).cast("long"))


def byte_rate_kbps(bytes_per_second: Column) -> Column:
    return F.when(bytes_per_second > 0, F.round(bytes_per_second * 8 / 1000).cast("long"))


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def distinct_names(names: Column) -> Column:
    """Cleaned, in order of arrival, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(names, clean_value), lambda n: n.isNotNull()))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def degrees(d: Column, m: Column, s: Column, hemisphere: Column, negative: str) -> Column:
    """Signed decimal degrees, negative where the hemisphere starts with `negative`; null if any part is."""
    value = d + m / 60 + s / 3600
    return F.when(F.startswith(F.upper(F.trim(hemisphere)), F.lit(negative)), -value).otherwise(value)


def altitude(value: Column, ref: Column) -> Column:
    return F.when(ref == 1, -value).otherwise(value)


def exif_time(text: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS`; null where month or day is out of range."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})", i)
    ok = part(2).try_cast("int").between(1, 12) & part(3).try_cast("int").between(1, 31)
    return F.when(ok, F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(1), part(2), part(3)), F.concat_ws(":", part(4), part(5), part(6))), F.lit("yyyy-MM-dd HH:mm:ss")))


def isbn(text: Column) -> Column:
    """Without prefix, dashes and spaces, upper-cased; null unless it has 13 digits, or 9 and a digit or X."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^urn:isbn:", ""), r"^isbn[:\s]*", ""), r"[\s\-]", "")
    return F.when(bare.rlike(r"^(\d{13}|\d{9}[\dx])$"), F.upper(bare))


def pdf_date(text: Column) -> Column:
    """`D:YYYYMMDDHHmmSS` and a zone as ISO 8601, with only the parts that are written; null for anything else."""
    pattern = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+\-])(\d{2})(?:'(\d{2})'?)?)?$"
    part = lambda i: found(F.trim(text), pattern, i)
    day = F.concat_ws("-", part(1), part(2), part(3))
    clock = F.concat_ws(":", part(4), F.coalesce(part(5), F.lit("00")), part(6))
    zone = F.coalesce(part(7), F.concat(part(8), part(9), F.lit(":"), F.coalesce(part(10), F.lit("00"))), F.lit(""))
    return F.when(part(4).isNotNull(), F.concat(day, F.lit("T"), clock, zone)).when(part(1).isNotNull(), day)


def clock_text(milliseconds: Column) -> Column:
    """`m:ss`; minutes aren't folded into hours."""
    seconds = F.floor(milliseconds / 1000)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def whole_or_decimal(n: Column) -> Column:
    return F.when(n == F.round(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def lossless(codec: Column) -> Column:
    """Null where the codec isn't known."""
    return F.when(codec.isNotNull(), F.lower(codec).isin("flac", "alac", "pcm"))

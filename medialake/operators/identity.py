"""Content identity: a hash of a file's two ends and its length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 20


def little_endian(n: Column) -> Column:
    """Eight bytes."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def sampled_sha256(content: Column, span: int = SPAN) -> Column:
    """Hash of the first and the last `span` bytes and the length; contents of up to two spans contribute whole."""
    data = content.cast("binary")
    n = F.octet_length(data).cast("long")
    ends = F.when(n <= 2 * span, data).otherwise(F.concat(F.substring(data, 1, span), F.substring(data, -span, span)))
    return F.sha2(F.concat(ends, little_endian(n)), 256)


def replace_rows(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """current with all rows of the incoming keys replaced."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def duplicates(files: DataFrame, value: str = "value", file: str = "file_id") -> DataFrame:
    """value, copies, first_file of contents that several files share. Counted before anything is gathered, so a hot value is one row a task."""
    return files.groupBy(value).agg(F.count(F.lit(1)).alias("copies"), F.min(file).alias("first_file")).where("copies > 1")

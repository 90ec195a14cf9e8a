"""Document fingerprints: the sum, modulo powers of two, of wide vectors hashed from paragraphs.

The order of paragraphs doesn't matter, and a paragraph can be added to or taken from a fingerprint without the rest of the text.
A hashed vector has small lanes, so the lanes of two fingerprints differ by as much as their paragraphs do, and a likeness can be read
from the fingerprints alone. Three lanes share a long: 16 bits each, 20 apart, so that a sum's carry is masked away.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

SEEDS = 8
#: Each hash gives five longs of three lanes.
SHIFTS = (0, 4, 8, 12, 16)
NIBBLES = 0xF | 0xF << 20 | 0xF << 40
LANES = 0xFFFF | 0xFFFF << 20 | 0xFFFF << 40
CARRY = 1 << 16 | 1 << 36 | 1 << 56
WIDTH = SEEDS * len(SHIFTS)
#: Line breaks and sentence ends close a paragraph.
BREAKS = r"[\r\n]+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column, breaks: str = BREAKS) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), breaks), lambda p: p != "")


def vector(paragraph: Column) -> Column:
    """The lanes of one paragraph, each 0 to 15."""
    hashes = F.array(*[F.xxhash64(F.lit(seed), paragraph) for seed in range(SEEDS)])
    return F.flatten(F.transform(hashes, lambda h: F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(NIBBLES)) for s in SHIFTS])))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(LANES)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.bitwiseOR(F.lit(CARRY)) - y).bitwiseAND(F.lit(LANES)))


def fingerprint(text: Column, breaks: str = BREAKS) -> Column:
    """struct(n: paragraphs, lanes: array of longs). A null or empty text has no paragraphs and all lanes 0."""
    parts = paragraphs(text, breaks)
    zero = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    return F.struct(F.size(parts).cast("long").alias("n"), F.aggregate(parts, zero, lambda acc, p: add(acc, vector(p))).alias("lanes"))


def insert(print_: Column, paragraph: Column) -> Column:
    return F.struct((print_["n"] + 1).alias("n"), add(print_["lanes"], vector(paragraph)).alias("lanes"))


def delete(print_: Column, paragraph: Column) -> Column:
    return F.struct((print_["n"] - 1).alias("n"), subtract(print_["lanes"], vector(paragraph)).alias("lanes"))


def as_text(print_: Column) -> Column:
    return F.concat(F.lpad(F.hex(print_["n"]), 8, "0"), F.array_join(F.transform(print_["lanes"], lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def centred(print_: Column) -> Column:
    """Twice each lane less its mean, as signed numbers."""
    lanes = F.flatten(F.transform(print_["lanes"], lambda x: F.array(*[F.shiftright(x, s).bitwiseAND(F.lit(0xFFFF)) for s in (0, 20, 40)])))
    return F.transform(lanes, lambda x: (F.pmod(2 * x - 15 * print_["n"] + 65536, F.lit(131072)) - 65536).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: an estimate of the share of paragraphs in common, 2 * a.b / (a.a + b.b); 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = centred(a), centred(b)
    both = dot(x, x) + dot(y, y)
    near = F.when(both > 0, 2 * dot(x, y) / both).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, bytes_per_bucket: int = 32 << 20, level: int = 64) -> DataFrame:
    """docs(key, text, ...) with the derived columns, and next_<column>: the values of the row with the next key; after the last, the first's. One shuffle of the rows.

    Keys are cut into ranges at quantiles, and ranges evenly into buckets of about bytes_per_bucket of text; each bucket also gets a copy of the next one's first row.
    A key that several quantiles name is a range of its own, cut by a hash of the text. Rows that repeat a key follow each other in the order of that hash, whose
    last part, for such a key, is dealt so that even equal rows are spread.
    """
    few = docs.agg(F.min("key"), F.max("key"), F.sum(F.octet_length("text"))).first()
    low, high, size = few[0] or 0, few[1] or 0, few[2] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bytes_per_bucket))
    parts = level if buckets <= 16 * level else level**2
    named = Counter(docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [])
    hot = {k for k, times in named.items() if times > 1}
    cuts = sorted({low, *named, *(k + 1 for k in hot if k < high)})
    stops = [*cuts[1:], high]
    share = parts / buckets  # quantiles a bucket
    fine = [max(1, math.ceil((named[k] if k in hot else 1) / share)) for k in cuts]
    listed = lambda xs, kind: f"array({', '.join(f'CAST({x} AS {kind})' for x in xs)})"
    array = lambda xs, kind: F.expr(listed(xs, kind))
    # two looks into at most `level` numbers find a key's range among level * level
    group = F.size(F.filter(array(cuts[::level], "long"), lambda c: c <= F.col("key")))
    within = F.element_at(F.expr(f"array({', '.join(listed(cuts[i : i + level], 'long') for i in range(0, len(cuts), level))})"), F.col("group"))
    of_range = lambda xs, kind: F.element_at(array(xs, kind), F.col("range"))
    at = docs.withColumn("group", group).withColumn("range", (F.col("group") - 1) * level + F.size(F.filter(within, lambda c: c <= F.col("key"))))
    is_hot = of_range([k in hot for k in cuts], "boolean")
    dealt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(-1)
    at = at.withColumn("hash", F.xxhash64("text", dealt))
    start, stop = (of_range(xs, "double") for xs in (cuts, stops))
    along = F.when(is_hot, F.col("hash") / 2.0**64 + 0.5).when(stop > start, (F.col("key").cast("double") - start) / (stop - start)).otherwise(0.0)
    inner = F.floor(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)) * of_range(fine, "int"))
    at = at.withColumn("bucket", F.col("range").cast("long") * max(fine) + F.least(inner, of_range(fine, "int") - 1)).drop("group", "range")

    # a row a bucket, so a small part of the rows
    firsts = at.groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("first"))
    before, last = F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy())
    firsts = firsts.select(F.col("first.key").alias("first_key"), F.col("first.hash").alias("first_hash"), F.coalesce(before, last).alias("to"), before.isNull().alias("wraps"))
    if buckets <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    copies = at.join(firsts, (F.col("key") == F.col("first_key")) & (F.col("hash") == F.col("first_hash"))).dropDuplicates(["to"]).withColumn("bucket", F.col("to"))
    both = at.withColumns({"wraps": F.lit(False), "copy": F.lit(False)}).unionByName(copies.withColumn("copy", F.lit(True)).drop("first_key", "first_hash", "to"))
    w = Window.partitionBy("bucket").orderBy("wraps", "key", "hash", "copy")
    return both.repartition("bucket").withColumns(derived or {}).withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("not copy").drop("bucket", "hash", "wraps", "copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by the start of the next document's (ascending id; after the last, the
    first). Null texts count as empty; null ids stand before all others; rows that repeat an id follow each other in the order of a hash.
    A table of one row is its own next. Other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "own"], {"own": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited})
    rows = rows.withColumn("edit", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

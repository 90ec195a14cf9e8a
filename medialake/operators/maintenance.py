"""Catalog maintenance: upserts, cascading deletes, migrations and checks."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import rebase


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """current with the incoming rows put in by key; columns in `keep`, and those that incoming lacks, stay as they are in rows that were there."""
    was = current.withColumn("was_there", F.lit(True))
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("comes"))
    both = was.join(new, keys, "full")
    value = lambda c: F.col(c) if f"new_{c}" not in new.columns else F.when(F.col("comes") & ((F.col("was_there").isNull()) | F.lit(c not in keep)), F.col(f"new_{c}")).otherwise(F.col(c))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in current.columns])


def cascade(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """children(name -> table, its column) without the rows that belong to the parents' keys."""
    gone = parents.select(F.col(key).alias("gone_key")).distinct()
    return {name: table.join(gone, table[column] == F.col("gone_key"), "left_anti") for name, (table, column) in children.items()}


def add_roots(roots: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roots with the new ones, and those rejected because their library has the path already."""
    key = ["library_id", "path"]
    fresh = incoming.dropDuplicates(key)
    return roots.unionByName(fresh.join(roots.select(*key), key, "left_anti")), fresh.join(roots.select(*key), key, "left_semi")


def remove_roots(roots: DataFrame, gone: DataFrame) -> DataFrame:
    """The roots without gone(library_id, path); files and items below them stay as they are."""
    return roots.join(gone.select("library_id", "path"), ["library_id", "path"], "left_anti")


def bad_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose text is no JSON object of this shape; nulls are fine."""
    shape = F.from_json(F.col(column), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return rows.where(F.col(column).isNotNull() & (shape.isNull() | shape["_bad"].isNotNull()))


def migrate_types(kind: Column) -> Column:
    """Library types of old catalogs under their present names."""
    return F.when(kind == "audio", "music").when(kind == "videos", "movies").otherwise(kind)


def drop_old_samples(hashes: DataFrame, version: int) -> DataFrame:
    """Before version 8 sampled hashes were made otherwise, and go."""
    return hashes.where("kind <> 'sampledSha256'") if version < 8 else hashes


def bad_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def orphans(children: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """relation, key of the rows whose key no parent has; children: relation -> (table, column, parent, its column). Null keys point nowhere and are fine."""
    found = None
    for name, (table, column, parent, parent_column) in children.items():
        lost = table.where(F.col(column).isNotNull()).select(F.col(column).alias("key")).join(parent.select(F.col(parent_column).alias("key")).distinct(), "key", "left_anti")
        lost = lost.select(F.lit(name).alias("relation"), F.col("key").cast("string"))
        found = lost if found is None else found.unionByName(lost)
    return found


def checksum(rows: DataFrame) -> DataFrame:
    """rows, xor: order-free and made by partial sums."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*rows.columns)).alias("xor"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, and of b that a lacks, counted as often as they stand."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


@dataclass
class Verified:
    """rows: what differs, with `side`. read: the ranges of keys that were read row by row, (low, high) with low in and high out, None for open; depth: how often ranges were cut into parts."""

    rows: DataFrame
    read: list[tuple]
    depth: int


def cut_points(rows: DataFrame, key: str, ranges: list[tuple], n: int, sample: int = 20_000) -> list[list]:
    """For each of the ranges, in order, at most n - 1 keys within it, from one sample of them all, that part its rows into about n equal ranges. They change no result."""
    rows, sample = rows.where(within_any(key, ranges) & F.col(key).isNotNull()).select(key), max(sample, 16 * n * len(ranges))
    share = min(1.0, sample / max(1, rows.count()))
    seen, out = sorted(r[0] for r in rows.sample(share, 7).limit(2 * sample).collect() if r[0] == r[0]), []
    for low, high in ranges:
        mine = seen[0 if low is None else bisect_left(seen, low) : len(seen) if high is None else bisect_left(seen, high)]
        out.append(sorted({c for i in range(1, n) if (c := mine[len(mine) * i // n]) != low}) if mine else [])
    return out


def within_range(key: str, low, high) -> Column:
    """Null keys are of the lowest range."""
    c = F.lit(True) if low is None else F.col(key) >= F.lit(low)
    c = c & (F.lit(True) if high is None else F.col(key) < F.lit(high))
    return F.coalesce(c, F.lit(low is None))


def within_any(key: str, ranges: list[tuple]) -> Column:
    return reduce(lambda x, y: x | y, [within_range(key, low, high) for low, high in ranges])


def nth_range(key: str, ends: list) -> Column:
    """How many of the sorted ends are not above the key, found by halving; 0 for a null key."""

    def among(start: int, stop: int) -> Column:
        if start == stop:
            return F.lit(start)
        middle = (start + stop) // 2
        return F.when(F.col(key) < F.lit(ends[middle]), among(start, middle)).otherwise(among(middle + 1, stop))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(among(0, len(ends)))


def range_digests(tables: list[DataFrame], key: str, parts: list[tuple]) -> list[dict[tuple, tuple]]:
    """Of each table, for each of the ordered parts (low, high) that has rows: how many, and two sums that don't mind their order. One job a table; a row a part comes to the driver."""
    ends = sorted({c for part in parts for c in part if c is not None})
    inside, nth, names = within_any(key, joined_ranges(parts)), nth_range(key, ends).alias("nth_range"), sorted(tables[0].columns)
    sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.lit(1), *names)), F.sum(F.xxhash64(F.lit(2), *names).cast("decimal(38,0)"))]
    bounds = [None, *ends, None]
    return [{(bounds[r[0]], bounds[r[0] + 1]): tuple(r[1:]) for r in rows.where(inside).groupBy(nth).agg(*sums).collect()} for rows in tables]


def verified(a: DataFrame, b: DataFrame, key: str, fan: int = 64, small: int = 100_000, most: int = 64, deepest: int = 4) -> Verified:
    """What differs between two tables of the same columns, found from the top of a tree of hashes over ranges of the key.

    Both tables are summed up once, by `fan` ranges; only ranges whose sums differ are cut again, all of them by one job a table, and read with a filter on the key that scans can use. A range
    of up to `small` rows, or at `deepest`, is compared row by row, each row as often as it stands. Where cutting again would leave over `most` ranges, those before it are compared: changes
    that lie all over a table cost one comparison of it, whatever its size. Equal tables are never compared row by row.
    """
    names = a.columns
    b = b.select(*names)
    leaves, todo, depth = [], [(None, None)], 0
    while todo and depth < deepest:
        cuts = cut_points(a.select(key).unionByName(b.select(key)), key, todo, max(4, min(fan, 4 * fan // len(todo))))
        parts = [part for (low, high), inner in zip(todo, cuts) for part in zip([low, *inner], [*inner, high])]
        one, two = range_digests([a, b], key, parts)
        whole, depth, new, done = {r for r, inner in zip(todo, cuts) if not inner}, depth + 1, [], []
        for part in parts:
            if one.get(part) != two.get(part):
                rows = max(one.get(part, (0,))[0], two.get(part, (0,))[0])
                (done if rows <= small or part in whole else new).append(part)
        if len(leaves) + len(done) + len(new) > most:
            break
        leaves, todo = leaves + done, new
    leaves = joined_ranges(leaves + todo)
    none = a.where("false").withColumn("side", F.lit("left"))
    if not leaves:
        return Verified(none, [], depth)
    return Verified(differences(a.where(within_any(key, leaves)), b.where(within_any(key, leaves))), leaves, depth)


def joined_ranges(ranges: list[tuple]) -> list[tuple]:
    """Ranges in order, those that touch made one."""
    out: list[tuple] = []
    for low, high in sorted(ranges, key=lambda r: (r[0] is not None, r[0])):
        if out and out[-1][1] is not None and out[-1][1] == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def relocate(roots: DataFrame, old: str, new: str) -> DataFrame:
    return roots.withColumn("path", rebase(F.col("path"), F.lit(old), F.lit(new)))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def not_dense(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose positions aren't 0, 1, 2, ..."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("low"), F.max(position).alias("high"), F.countDistinct(position).alias("distinct")).where("low <> 0 OR high <> n - 1 OR distinct <> n").select(key)


def rename(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with the name of names(key, new_name) where it has one."""
    return rows.join(names, key, "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def with_identity(libraries: DataFrame, known: DataFrame, salt: str) -> DataFrame:
    """libraries(library_id, ...) with a uuid: the one of known(library_id, uuid), else one made once from the id and a salt, so that writing it again gives the same."""
    digest = F.sha2(F.concat_ws("/", F.lit(salt), F.col("library_id").cast("string")), 256)
    part = lambda start, n: F.substring(digest, start, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    return libraries.join(known, "library_id", "left").withColumn("uuid", F.coalesce("uuid", made))


def in_shape(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rows of an older catalog in today's shape: columns added since are null, those dropped are gone."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])

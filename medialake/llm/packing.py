"""Best-fit packing of tokenised documents: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches, spread
from .tokens import ByteBpe

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, bpe_files: tuple[str, ...], most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. A document longer than `most` is cut so that its first piece takes the odd length.

    bpe_files: what ByteBpe takes: the tokenizers file and, if wanted, the same vocabulary as ranks and its pattern. Null texts count as empty: one piece,
    the end id. Null and repeated ids are carried along as they are; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*bpe_files)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, tokens in zip(ids, bpe.batch(batch.column(1).to_pylist())):
                tokens += end
                n = len(tokens) // 4
                stops = range(n - most * ((n - 1) // most), n + 1, most)
                start = 0
                for i, stop in enumerate(stops):
                    out.append((doc, i, start, stop - start, zlib.crc32(tokens[4 * start : 4 * stop])))
                    start = stop
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select(F.col(id_col).cast("long"), F.coalesce(text_col, F.lit("")))).mapInArrow(cut, PIECE)


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Every way of filling a sequence of `bins` with 2 to `parts` documents, each a number of bins, larger first."""
    out: list[tuple[int, ...]] = []

    def fill(taken: tuple[int, ...], room: int) -> None:
        if not room:
            out.append(taken)
        elif len(taken) < parts:
            for b in range(min(room, taken[-1] if taken else bins), 0, -1):
                if b * (parts - len(taken)) < room:
                    break
                fill((*taken, b), room - b)

    fill((), bins)
    return [p for p in out if len(p) > 1]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """The x >= 0 of least |ax - b|, by active sets: the column that helps most enters, those that turn negative leave."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if active.all() or gain.max() <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[int(gain.argmax())] = True
        while True:
            fit = np.zeros_like(x)
            fit[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (fit <= 0)
            if not low.any():
                x = fit
                break
            step = np.min(x[low] / (x[low] - fit[low] + 1e-12))
            x = x + step * (fit - x)
            active &= x > 1e-9
            x[~active] = 0
    return x


def repeats(counts: np.ndarray, parts: int = 3, light: int = 4, light_weight: float = 0.1) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often to use each: the fit to counts (documents of 1 to n bins), rounded, within what there is.

    Short documents, up to `light` bins, weigh less in the fit: they fill what is left over.
    """
    bins = len(counts)
    ways = patterns(bins, parts)
    a = np.zeros((bins, len(ways)), np.float64)
    for j, way in enumerate(ways):
        for b in way:
            a[b - 1, j] += 1
    weight = np.where(np.arange(1, bins + 1) <= light, light_weight, 1.0)
    x = nnls(a * weight[:, None], counts * weight)
    left, out = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        if x[j] <= 0:
            break
        need = a[:, j].astype(np.int64)
        used = need > 0
        n = int(min(round(x[j]), (left[used] // need[used]).min()))
        if n > 0:
            out.append((ways[j], n))
            left -= need * n
    return out


def best_fit(lengths: np.ndarray, open_free: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order: the sequence and the free space found there; sequences are those already open, then new ones."""
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    mask, new = 0, len(open_free)
    for i, free in enumerate(open_free):
        rooms[free].append(i)
        mask |= 1 << int(free)
    at, found = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(map(int, lengths)):
        wide = mask >> n
        if wide:
            free = n + (wide & -wide).bit_length() - 1
            seq = rooms[free].pop()
            if not rooms[free]:
                mask &= ~(1 << free)
        else:
            seq, free, new = new, most, new + 1
        at[i], found[i] = seq, free
        if free > n:
            rooms[free - n].append(seq)
            mask |= 1 << (free - n)
    return at, found


def pack(pieces: DataFrame, most: int = 2048, grid: int = 8, parts: int = 3, group: int = 4000) -> DataFrame:
    """The pieces with sequence_id and offset: sequences of at most `most` tokens, as few as the patterns and best fit find.

    Full pieces stand alone. The others are counted by length, in steps of `grid`; patterns of up to `parts` of them that fill a sequence
    get repeat counts, and each piece's rank among its length's says which repeat of which pattern it joins. What is left over is packed
    by best fit, in groups of about `group` pieces and at most five times as many open sequences, first into what the patterns left free and then into new sequences.
    Pieces are dealt by the number of their row in the saved table, so pieces that are equal in all columns, null ids included, are spread like others.
    Only the histogram and the patterns, both bounded by `most`, pass through the driver. Ranks are counted in salted parts of a length,
    so one length may hold any share of the rows. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    rows = saved(pieces.withColumns({"bin": F.ceil(F.col("length") / grid).cast("int"), "row": F.monotonically_increasing_id()}), "pack-pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    by_length = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `most` rows at most
    bins = most // grid
    counts = np.zeros(bins, np.int64)
    for length, n in by_length.items():
        if length < most:
            counts[-(-length // grid) - 1] += n
    used = repeats(counts, parts)
    taken, stretches, first = np.zeros(bins, np.int64), [], 0
    for way, n in used:
        for b in sorted(set(way)):
            each = way.count(b)
            stretches.append((b, int(taken[b - 1]), int(taken[b - 1]) + each * n, each, first))
            taken[b - 1] += each * n
        first += n
    plan = F.broadcast(spark.createDataFrame(stretches, "of_bin int, low long, high long, each int, first long"))  # a few rows a length

    full = rows.where(F.col("length") == most).select(*columns, (4 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    total = int(counts.sum())
    slots = max(1, math.ceil(total / 4000))
    odd = rows.where(F.col("length") < most).withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int"))
    sizes = odd.groupBy("bin", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bin", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("bin", "slot").orderBy("row"))
    ranked = odd.withColumn("nth", nth).join(sizes, ["bin", "slot"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    found = (F.col("bin") == F.col("of_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    dealt = ranked.join(plan, found, "left").withColumn("pattern", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    dealt = saved(dealt.select(*columns, "row", "pattern"), "pack-dealt")

    inside = Window.partitionBy("pattern").orderBy(F.desc("length"), "row")
    placed = dealt.where("pattern IS NOT NULL").withColumn("upto", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.select(*columns, (4 * F.col("pattern") + 1).alias("sequence_id"), (F.col("upto") - F.col("length")).alias("offset"))

    left = max(0, total - int(taken.sum()))
    groups = max(1, math.ceil(left / group), math.ceil((left + first) / (5 * group)))  # neither pieces nor open sequences pile up in a group
    rest = dealt.where("pattern IS NULL").select(*columns, "row", F.lit(None).cast("long").alias("open_id"), F.lit(0).cast("long").alias("filled"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long").alias("part"))
    opened = placed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < most)
    opened = opened.select(*[F.lit(None).cast(rest.schema[c].dataType).alias(c) for c in (*columns, "row")], F.col("sequence_id").alias("open_id"), "filled", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("long").alias("part"))

    def fit(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        room = df[df.open_id.notna()].sort_values("open_id")
        todo = df[df.open_id.isna()].sort_values(["length", "row"], ascending=[False, True])
        at, free = best_fit(todo.length.to_numpy(np.int64), most - room.filled.to_numpy(np.int64), most)
        known = room.open_id.to_numpy(np.int64)
        fresh = (int(key[0]) << 32) + at
        seq = np.where(at < len(known), np.append(known, 0)[np.minimum(at, len(known))], 4 * fresh + 2)
        return todo[columns].assign(sequence_id=seq, offset=most - free)

    fitted = rest.unionByName(opened).groupBy("part").applyInPandas(fit, f"{PIECE}, sequence_id long, offset long")
    return full.unionByName(placed).unionByName(fitted)

"""Quality by pairwise ranking: a Bradley-Terry model learns scores from preference pairs, and a score quantile is the threshold."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType

from .common import all_labelled, crc_bucket, saved, small_batches, spread

#: Width of a bin of scores by which rows meet.
WIDTH = 0.125

FEATURES = ("log_chars", "upper", "exclaim", "marks", "bars", "digits", "blanks", "lines", "word_length", "distinct", "top_word", "runs", "repeated_lines", "stops")


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text: shares of kinds of characters, and how much words and lines repeat. Null and empty texts are all 0."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        n, words = int(raw.sum()), text.split()
        letters = max(1, raw[65:91].sum() + raw[97:123].sum())
        w = max(1, len(words))
        counts = Counter(words)
        lines = text.split("\n")
        top = counts.most_common(1)[0][1] if counts else 0
        out[i] = (
            np.log1p(n), raw[65:91].sum() / letters, (raw[33] / w) ** 0.5, (raw[[35, 36, 37, 38, 42, 43, 61, 64, 94, 126]].sum() / w) ** 0.5, (raw[124] / w) ** 0.5, raw[48:58].sum() / n, (raw[32] + raw[9]) / n,
            len(lines) / w, min(20.0, n / w), np.log(max(1, len(counts))) / np.log(w + 1), top / w, (sum(map(str.__eq__, words, words[1:])) / w) ** 0.5, 1 - len(set(lines)) / len(lines), (raw[46] + raw[44]) / w,
        )
    return out


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs less the text, with its features as an array."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(names.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, c in enumerate(names) if c != text_col], pa.array(list(x), pa.list_(pa.float32()))], names=[*[c for c in names if c != text_col], "features"])

    kept = StructType([f for f in docs.schema.fields if f.name != text_col])
    return docs.mapInArrow(measure, kept.add("features", ArrayType(FloatType())))


@dataclass
class Ranking:
    """A score is weights . (features - mean) / scale; at the threshold it is mapped to `at`, and rises by `slope` for a unit of score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    at: float = 0.7
    slope: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold) + np.log(self.at / (1 - self.at)), -40, 40)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, l2: float = 1e-3, rounds: int = 30, seed: int = 7) -> Ranking:
    """Learns from pairs (better, worse) drawn from rows labelled 1 and 0: logistic loss on the difference of their features, by Newton steps.

    The threshold is the quantile of the scores that leaves as many rows below it as are labelled 0.
    Without rows of both labels all scores are equal, and as good as the label that there is.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if len(x) else len(FEATURES))
    if not len(good) or not len(bad):
        return Ranking(mean, scale, w, -1.0 if len(good) else 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w)), d.T @ (1 - p) / pairs - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    ranking = Ranking(mean, scale, w, 0.0)
    raw = ranking.raw(x)
    order = np.sort(raw)
    k = min(len(order) - 1, len(bad))
    ranking.threshold = float((order[k - 1] + order[k]) / 2)
    return ranking


def sums_by_bin(rows: DataFrame, ranking: Ranking) -> dict[tuple[int, int], np.ndarray]:
    """Of rows(label, features): (label, bin of the score) -> count, sum and sum of outer products of the scaled features. Summed up within tasks, then by bin."""
    size = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.float64)
            z = np.clip((x - ranking.mean) / ranking.scale, -8, 8)
            keys = np.stack([batch.column(0).to_numpy(), np.floor(z @ ranking.weights / WIDTH).astype(np.int64)], 1)
            found, of = np.unique(keys, axis=0, return_inverse=True)
            for i, key in enumerate(map(tuple, found.tolist())):
                m = z[of.ravel() == i]
                sums[key] = sums.get(key, 0) + np.concatenate([[len(m)], m.sum(axis=0), (m.T @ m).ravel()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["label", "bin", "sums"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        each = np.stack(table.column("sums").to_pylist()).sum(axis=0)
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "bin": pa.array([key[1].as_py()], pa.int64()), "sums": pa.array([each], pa.list_(pa.float64()))})

    shape = "label int, bin long, sums array<double>"
    got = rows.select("label", "features").mapInArrow(add, shape).groupBy("label", "bin").applyInArrow(total, shape).collect()
    return {(r.label, r.bin): np.array(r.sums) for r in got}


def all_pairs(rows: DataFrame, ranking: Ranking, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """The Bradley-Terry weights over every pair of a row labelled 1 and one labelled 0, by Newton steps. Rows meet by bins of their scores, WIDTH wide, each of the mean score of its rows, so a round reads every row once."""
    w, size = ranking.weights, len(FEATURES)
    for _ in range(rounds):
        ranking.weights = w
        sums = sums_by_bin(rows, ranking)
        good, bad = (np.stack([s for (label, _), s in sorted(sums.items()) if label == y]) for y in (1, 0))
        (n, x, xx), (m, v, vv) = ((s[:, 0], s[:, 1 : size + 1], s[:, size + 1 :].reshape(-1, size, size)) for s in (good, bad))
        p = 1 / (1 + np.exp(-np.clip((x @ w / n)[:, None] - (v @ w / m)[None], -40, 40)))
        pairs, miss, k = n.sum() * m.sum(), 1 - p, p * (1 - p)
        slope = (miss @ m) @ x - (n @ miss) @ v
        cross = x.T @ k @ v
        bend = np.tensordot(k @ m, xx, 1) + np.tensordot(n @ k, vv, 1) - cross - cross.T
        step = np.linalg.solve(bend / pairs + l2 * np.eye(size), slope / pairs - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def rank_of_all(rows: DataFrame, ranking: Ranking, k: int) -> float:
    """Halfway between the k-th lowest score of all rows and the next, both exact: bins are counted, and only those that hold the two are looked into."""
    raw = F.udf(lambda x: float(ranking.raw(np.array([x], np.float64))[0]), "double")
    scores = rows.select(raw("features").alias("s")).withColumn("bin", F.floor(F.col("s") * 1024))
    counts, before, wanted = sorted((r["bin"], r["count"]) for r in scores.groupBy("bin").count().collect()), 0, []
    for b, n in counts:
        wanted += [(b, at - before) for at in (k - 1, k) if before <= at < before + n]
        before += n
    found = []
    for b, at in wanted:
        for r in scores.where(F.col("bin") == b).groupBy("s").count().orderBy("s").collect():
            if at < r["count"]:
                found.append(r["s"])
                break
            at -= r["count"]
    return sum(found) / len(found)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Learns from all labelled rows that aren't held out (crc32 of the id, modulo 4, is 2) and all their pairs; the features are written, and only sums of them come to the driver."""
    rows = saved(with_features(all_labelled(spread(docs), labels, label_col, 4, 2, id_col, text_col)).select("label", "features"), "quality-features")
    each = [f(F.get("features", F.lit(i)).cast("double")) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]
    good, bad, *rest = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *each).first()
    if not good + bad:
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 1.0)
    ranking = Ranking(np.array(rest[: len(FEATURES)]), np.array(rest[len(FEATURES) :]) + 1e-6, np.zeros(len(FEATURES)), 0.0)
    if not good or not bad:
        ranking.threshold = -1.0 if good else 1.0
        return ranking
    ranking.weights = all_pairs(rows, ranking)
    ranking.threshold = rank_of_all(rows, ranking, min(good + bad - 1, bad))
    return ranking


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", predict_at: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null and empty texts get the score of a text whose features are all 0; a null id is never held out; repeated rows are each scored; other columns are ignored."""
    model = train(docs, labels, id_col, text_col)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_bucket(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= predict_at).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return spread(rows).mapInArrow(rate, StructType([*rows.schema.fields[:2]]).add("score", DoubleType()).add("predicted", IntegerType()))

"""Toxic spans by a linear-chain conditional random field over words; its marginals give a score for the document and the offending offsets.

Only documents are labelled. A word counts as a labelled toxic token where it stands in a toxic document and it, or one of its prefixes,
occurs in toxic documents far more often than chance allows. A chain is a sentence or line. A token's features are these terms, and whether the words
before and after it have any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as laid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import Tables, crc_bucket, labelled, small_batches, spread
from .words import starts_of, stretches

PREFIXES = (4, 5, 6, 7)
#: Evidence beyond which a document is no surer to be toxic.
MOST = 12.0
#: Words, and the marks that end a chain.
TOKEN = re.compile(r"\w+|[.!?\n]")
BREAKS = frozenset(".!?\n")
#: A longer chain is cut here for learning.
LONGEST = 400


def terms_of(word: str) -> list[str]:
    """The word, marked as whole, and its prefixes."""
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) >= n]]


def chain(emission: np.ndarray, starts: np.ndarray, move: np.ndarray, begin: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, each of sum 1, of many two-state chains laid end to end.

    emission: the log weight of state 1 less that of state 0 of each token; starts: True at the first token of a chain; move: log
    weights of transitions; begin: the log weight of state 1 at a start. The tokens are cut into blocks: products of each block's matrices
    give what enters every block, and all blocks then go forward, or back, together.
    """
    n = len(emission)
    rows = -(-n // block)
    e = np.zeros(rows * block)
    e[:n] = np.clip(emission, -30, 30)
    first = np.zeros(rows * block, bool)
    first[:n] = starts
    first[n:] = True
    one = np.exp(e).reshape(rows, block)
    m = [[np.where(first.reshape(rows, block), math.exp(begin[j]), math.exp(move[i][j])) * (one if j else 1.0) for j in (0, 1)] for i in (0, 1)]

    p = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
    for k in range(block):
        p = [[p[i][0] * m[0][j][:, k] + p[i][1] * m[1][j][:, k] for j in (0, 1)] for i in (0, 1)]
        total = p[0][0] + p[0][1] + p[1][0] + p[1][1]
        p = [[x / total for x in r] for r in p]
    entering, leaving = np.empty((rows, 2)), np.empty((rows, 2))
    a = b = (0.5, 0.5)
    p00, p01, p10, p11 = (p[i][j].tolist() for i in (0, 1) for j in (0, 1))
    for r in range(rows):
        entering[r] = a
        x, y = a[0] * p00[r] + a[1] * p10[r], a[0] * p01[r] + a[1] * p11[r]
        a = (x / (x + y), y / (x + y))
    for r in range(rows - 1, -1, -1):
        leaving[r] = b
        x, y = p00[r] * b[0] + p01[r] * b[1], p10[r] * b[0] + p11[r] * b[1]
        b = (x / (x + y), y / (x + y))
    alpha, beta = np.empty((rows, block, 2)), np.empty((rows, block, 2))
    x, y = entering[:, 0], entering[:, 1]
    for k in range(block):
        x, y = x * m[0][0][:, k] + y * m[1][0][:, k], x * m[0][1][:, k] + y * m[1][1][:, k]
        total = x + y
        x, y = x / total, y / total
        alpha[:, k, 0], alpha[:, k, 1] = x, y
    x, y = leaving[:, 0], leaving[:, 1]
    for k in range(block - 1, -1, -1):
        beta[:, k, 0], beta[:, k, 1] = x, y
        x, y = m[0][0][:, k] * x + m[0][1][:, k] * y, m[1][0][:, k] * x + m[1][1][:, k] * y
        total = x + y
        x, y = x / total, y / total
    return alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, starts: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The probability of state 1 at each token."""
    if not len(emission):
        return np.zeros(0)
    alpha, beta = chain(emission, starts, move, begin)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


@dataclass
class Field:
    """What a toxic token weighs more than a clean one: bias, a weight for each term, weights of a neighbour with terms, log weights of transitions and of the start.

    calibration: the log odds that a document is toxic, for each unit of evidence and for none.
    """

    terms: dict[str, int]
    weights: np.ndarray
    bias: float
    move: np.ndarray
    begin: np.ndarray
    beside: tuple[float, float] = (0.0, 0.0)
    calibration: tuple[float, float] | None = None

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return 1 - np.exp(-evidence)
        slope, base = self.calibration
        return 1 / (1 + np.exp(-slope * np.minimum(evidence, MOST) - base))

    def own(self, word: str) -> tuple[float, bool]:
        """A token's weight but for its neighbours, and whether it has terms."""
        found = [k for t in terms_of(word.lower()) if (k := self.terms.get(t)) is not None]
        return self.bias + sum(float(self.weights[k]) for k in found), bool(found)


def beside(hits: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the token before, and the one after, within the chain, has terms."""
    before, after = np.zeros(len(hits), bool), np.zeros(len(hits), bool)
    before[1:] = hits[:-1] & ~starts[1:]
    after[:-1] = hits[1:] & ~starts[1:]
    return before, after


def fit(seen: np.ndarray, labels: np.ndarray, starts: np.ndarray, times: np.ndarray, terms: dict[str, int], rounds: int = 120, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """Conditional likelihood of labelled token chains, by Adam. seen: a row for each token, the numbers of its terms, or -1; times: how often its chain occurs."""
    k = len(terms)
    w = np.concatenate([np.zeros(k), [-3.0, 0.0, -1.0, 0.0, 0.0, -3.0, 0.0, 0.0]])  # terms, bias, moves 00 01 10 11, begin 1, hit before, hit after
    have = seen >= 0
    at_rows, flat = np.nonzero(have)[0], seen[have]
    before, after = beside(have.any(axis=1), starts)
    follows = ~starts
    follows[:1] = False
    pairs = follows[1:]
    here, there, often = labels[:-1][pairs], labels[1:][pairs], times[1:][pairs]

    def expected(p: np.ndarray, joint: list[float]) -> np.ndarray:
        p = p * times
        return np.concatenate([np.bincount(flat, p[at_rows], k), [p.sum(), *joint, p[starts].sum(), p[before].sum(), p[after].sum()]])

    data = expected(labels, [(often * x * y).sum() for x in (1 - here, here) for y in (1 - there, there)])
    marks, mean, var = max(1.0, float((labels * times).sum())), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        move = w[k + 1 : k + 5].reshape(2, 2)
        begin = np.array([0.0, w[k + 5]])
        e = w[k] + np.bincount(at_rows, w[:k][flat], len(labels)) + w[k + 6] * before + w[k + 7] * after
        alpha, beta = chain(e, starts, move, begin)
        p = alpha * beta
        p = p[:, 1] / p.sum(axis=1)
        joint = np.stack([alpha[:-1, i] * np.exp(move[i][j]) * (np.exp(np.clip(e[1:], -30, 30)) if j else 1.0) * beta[1:, j] for i in (0, 1) for j in (0, 1)])
        joint = ((joint / joint.sum(axis=0))[:, pairs] * often).sum(axis=1)
        gradient = (data - expected(p, list(joint))) / marks - l2 * w
        mean, var = 0.9 * mean + 0.1 * gradient, 0.99 * var + 0.01 * gradient**2
        w = w + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    return Field(terms, w[:k], float(w[k]), w[k + 1 : k + 5].reshape(2, 2), np.array([0.0, w[k + 5]]), (float(w[k + 6]), float(w[k + 7])))


def term_counts(rows: DataFrame) -> DataFrame:
    """rows(doc_id, label, text) -> term, bad, good: in how many toxic and other documents it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(by[0].keys() | by[1].keys())
            done = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([b[t] for t in every], pa.int64()) for b in (by[1], by[0])]], names=["term", "bad", "good"])
            by[0].clear(), by[1].clear()
            return done

        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by[toxic == 1].update({t for w in {w.lower() for w in TOKEN.findall(text)} - BREAKS for t in terms_of(w)})
                if len(by[0]) + len(by[1]) > 300_000:
                    yield out()
        yield out()

    return rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def telling(counts: DataFrame, bad: int, good: int, least: int = 3) -> list[str]:
    """The terms that toxic documents have far more often than chance allows: by the likelihood ratio, held against the number of terms that are tried."""
    share = bad / (bad + good)
    counts = counts.where(F.col("bad") + F.col("good") >= least)
    part = lambda x, of: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (F.col("bad") + F.col("good")) / of)).otherwise(0.0)
    odd = counts.where((F.col("bad") >= least) & (3 * F.col("bad") >= 2 * F.col("good"))).withColumn("gain", part("bad", share) + part("good", 1 - share))
    every = counts.count()
    return sorted(r["term"] for r in odd.where(F.col("gain") >= math.log(max(1, every)) + 3).select("term").collect())


def chains_of(text: str, toxic: bool, terms: dict[str, int]) -> Iterator[tuple[bool, bytes]]:
    """For each chain: whether its tokens with terms are toxic, and its length and, for each such token, place, number of terms and terms, as 32-bit integers."""
    places: list[int] = []
    n = 0
    for token in [*TOKEN.findall(text), "\n"]:
        if token in BREAKS or n == LONGEST:
            if n:
                yield toxic and bool(places), np.asarray([n, *places], "<i4").tobytes()
            places, n = [], 0
        if token not in BREAKS:
            found = [k for t in terms_of(token.lower()) if (k := terms.get(t)) is not None]
            if found:
                places += [n, len(found), *found]
            n += 1


def within_bytes(rows: DataFrame, most: int) -> DataFrame:
    """rows(doc_id, label, text) without very long texts, or about so many of them, by a hash of the id, as have `most` bytes."""
    size = F.octet_length("text")
    short = rows.where(size <= most // 16)
    total = short.agg(F.sum(size.cast("long"))).first()[0] or 0
    return short if total <= most else short.where(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1_000_000)) < math.floor(1_000_000 * most / total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 12_000, max_bytes: int = 256 << 20) -> Field:
    """Learns from about max_docs labelled documents that aren't held out (crc32 of the id, modulo 3, is 1), or fewer, so that their texts are about max_bytes, chosen by a hash of the id. A text
    of more than a sixteenth of max_bytes isn't learned from. So what reaches the driver, a few bytes for each word that has terms, is bounded; nothing else is.

    Spark counts in how many toxic and clean ones each term occurs, and how often each chain occurs, over whole texts: a chain is known by its length and by the terms
    at its places, so those without terms are few. The different chains come to the driver, where the field is fitted to them; then the evidence of all these documents,
    to which the score is calibrated.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with Tables(spark) as tables:
        rows = tables.save(labelled(docs, labels, label_col, 3, 1, id_col, text_col, max_docs), "toxicity-labelled")
        rows = within_bytes(rows, max_bytes).repartition(spark.sparkContext.defaultParallelism)
        n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if not n.get(1) or not n.get(0):
            return Field({}, np.zeros(0), 30.0 if n.get(1) else -30.0, np.zeros((2, 2)), np.zeros(2))
        terms = {t: i for i, t in enumerate(telling(tables.save(term_counts(rows), "toxicity-terms"), n[1], n[0]))}

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            times: Counter[tuple[bool, bytes]] = Counter()
            for batch in batches:
                for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    times.update(chains_of(text, toxic == 1, terms))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in times], pa.bool_()), pa.array([k[1] for k in times], pa.binary()), pa.array(list(times.values()), pa.int64())], names=["marked", "chain", "n"])

        got = rows.mapInArrow(encode, "marked boolean, chain binary, n long").groupBy("marked", "chain").agg(F.sum("n").alias("n")).orderBy("marked", "chain").toArrow()
        model = fitted(got.column("marked").to_pylist(), got.column("chain").to_pylist(), got.column("n").to_pylist(), terms)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(model)
            for batch in batches:
                found = [scorer.texts(part, False)[0] for part in stretches(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *found]))], names=["doc_id", "label", "evidence"])

        told = rows.mapInArrow(weigh, StructType([*rows.schema.fields[:2]]).add("evidence", DoubleType())).orderBy("doc_id").toArrow()
    model.calibration = logistic(np.minimum(told.column("evidence").to_numpy(), MOST), told.column("label").to_numpy() == 1)
    return model


def fitted(marked: list[bool], chains: list[bytes], times: list[int], terms: dict[str, int]) -> Field:
    """The field of these chains, each as `chains_of` gives it."""
    sizes = [int.from_bytes(c[:4], "little") for c in chains]
    seen = np.full((sum(sizes), 1 + len(PREFIXES)), -1, np.int64)
    labels, first = np.zeros(len(seen)), starts_of(np.asarray(sizes, np.int64))
    for toxic, raw, start in zip(marked, chains, first):
        coded, at = np.frombuffer(raw, "<i4"), 1
        while at < len(coded):
            place, k = start + coded[at], coded[at + 1]
            seen[place, :k] = coded[at + 2 : at + 2 + k]
            labels[place] = toxic
            at += 2 + k
    starts = np.zeros(len(seen), bool)
    starts[first] = True
    if not len(seen):
        return Field(terms, np.zeros(len(terms)), -30.0, np.zeros((2, 2)), np.zeros(2))
    return fit(seen, labels, starts, np.repeat(np.asarray(times, np.float64), sizes), terms)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and base of the log odds of y, by Newton steps."""
    z = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(2), z.T @ (y - p) - l2 * w)
        w += np.clip(step, -2, 2)
    return max(0.0, float(w[0])), float(w[1])


class Scorer:
    """Scores texts by a field, each different word's weight kept."""

    def __init__(self, model: Field, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.forget()

    def forget(self) -> None:
        """The marks that end a chain come first."""
        self.known: dict[str, int] = {b: i for i, b in enumerate(sorted(BREAKS))}
        self.weights, self.hits = np.zeros(len(BREAKS)), np.zeros(len(BREAKS), bool)

    def texts(self, texts: list[str], spans: bool, sure: float = 0.5, maybe: float = 0.05) -> tuple[np.ndarray, list[list[dict]]]:
        """For each text the evidence, -log of the probability that no span is toxic, and the spans whose most toxic word has a probability of `sure` or more.

        A span's start and stop are in characters of the text as it is.
        """
        if len(self.known) > self.keep:
            self.forget()
        found = list(map(TOKEN.findall, texts))
        new = list(set(laid.from_iterable(found)).difference(self.known))
        own = [self.model.own(w) for w in new]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.weights = np.append(self.weights, [e for e, _ in own])
        self.hits = np.append(self.hits, np.array([h for _, h in own], bool))
        tokens = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(map(self.known.__getitem__, laid.from_iterable(found)), np.int64, int(tokens.sum()))
        word = ids >= len(BREAKS)
        opens = np.append(True, ~word[:-1]) if len(word) else word
        opens[starts_of(tokens)[tokens > 0]] = True
        owner = np.repeat(np.arange(len(texts)), tokens)[word]
        ids, starts = ids[word], opens[word]
        hits = self.hits[ids]
        before, after = beside(hits, starts)
        p = marginals(self.weights[ids] + self.model.beside[0] * before + self.model.beside[1] * after, starts, self.model.move, self.model.begin)
        # the words of a span stand side by side in one chain and are each toxic with a probability of `maybe` or more
        inside = np.flatnonzero(p >= maybe)
        opened = np.ones(len(inside), bool)
        opened[1:] = (np.diff(inside) > 1) | starts[inside[1:]]
        span = np.cumsum(opened) - 1
        top = np.zeros(int(opened.sum()))
        np.maximum.at(top, span, p[inside])
        doc = owner[inside[opened]]
        evidence = -np.bincount(doc, np.log1p(-np.minimum(top, 1 - 1e-9)), len(texts)).astype(np.float64)
        at: list[list[dict]] = [[] for _ in texts]
        if spans:
            bounds = np.append(np.flatnonzero(opened), len(inside))
            first = np.searchsorted(owner, np.arange(len(texts)))
            for d in np.unique(doc[top >= sure]):
                places = [m.span() for m in TOKEN.finditer(texts[d]) if m.group() not in BREAKS]
                for s in np.flatnonzero((doc == d) & (top >= sure)):
                    at[d].append({"start": places[inside[bounds[s]] - first[d]][0], "stop": places[inside[bounds[s + 1] - 1] - first[d]][1], "prob": float(top[s])})
        return evidence, at


def tag(docs: DataFrame, model: Field, text_col: str = "text", score_col: str = "score", spans_col: str | None = "spans") -> DataFrame:
    """docs less columns of these names, with score_col added, and spans_col where it is named: start, stop and prob of each toxic span, in characters of the text.

    Null texts and texts without words get the score of no evidence, and have no spans.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col, *([spans_col] if spans_col else []))
    names = docs.columns
    span_type = StructType().add("start", LongType()).add("stop", LongType()).add("prob", DoubleType())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for part in stretches([t or "" for t in batch.column(names.index(text_col)).to_pylist()]):
                evidence, at = scorer.texts(part, spans_col is not None)
                scores.append(model.score(evidence))
                spans += at
            new = [pa.array(np.concatenate(scores), pa.float64())]
            if spans_col:
                new.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("prob", pa.float64())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, score_col, *([spans_col] if spans_col else [])])

    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())
    return spread(docs).mapInArrow(rate, schema.add(spans_col, ArrayType(span_type)) if spans_col else schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", predict_at: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, spans. A null id is never held out; repeated rows are each scored; other columns are ignored. Without labels of both kinds nothing is toxic, or everything."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_bucket(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return tag(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= predict_at).cast("int").alias("predicted"), "spans")

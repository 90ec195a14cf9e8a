"""Language identification by words first, then by ever shorter character n-grams of the words that aren't known."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import Tables, crc_bucket, small_batches, spread
from .words import stretches, sums_of

UND = "und"
#: A run of letters, digits or underscores; marks such as accents and vowel signs belong to it.
WORD = regex.compile(r"\w+")


def spoken(text: str) -> list[str]:
    """The words of a text, lower-cased: one rule for learning and predicting."""
    return WORD.findall(text.lower())


@dataclass
class Backoff:
    """The languages; a row of log frequencies, one a language, for each known word and n-gram; and where to find it."""

    langs: list[str]
    table: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    longest: int

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is a word's score: its own, or those of its known n-grams of the greatest length that has any."""
        if (own := self.words.get(word)) is not None:
            return [own]
        marked = f"<{word}>"
        for n in range(min(self.longest, len(marked)), 0, -1):
            found = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
            if found:
                return found
        return []

    def scores(self, new: list[str]) -> np.ndarray:
        found = list(map(self.rows, new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return sums_of(self.table[flat], sizes) / np.maximum(sizes, 1)[:, None].astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1000, longest: int = 4, least: int = 3) -> Backoff:
    """Learns from about max_docs rows of each language that aren't held out (crc32 of the id, modulo 4, is 2), chosen by a hash of the id; one row an id and language.

    Words, cut by the same rule as in `identify`, and their n-grams are counted by Spark; all that occur `least` times in those rows make up the model, which only
    max_docs bounds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_bucket(F.col(id_col), 4) != 2))
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    each = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(each)
    if not langs:
        return Backoff([], np.zeros((0, 0), np.float32), {}, {}, longest)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, math.ceil(1_000_000 * max_docs / each[lang]))]), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < share).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def packed(times: Counter[tuple[str, int, str]]) -> pa.RecordBatch:
        keys = list(zip(*times)) or [(), (), ()]
        done = pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()), pa.array(list(times.values()), pa.int64())], names=["lang", "size", "term", "n"])
        times.clear()
        return done

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                times.update((lang, 0, w) for w in spoken(text))
                if len(times) > 300_000:
                    yield packed(times)
        yield packed(times)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words and, with each word's ends marked, their n-grams."""
        times: Counter[tuple[str, int, str]] = Counter()
        for batch in batches:
            for lang, term, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                times[lang, 0, term] += n
                marked = f"<{term}>"
                for size in range(1, min(longest, len(marked)) + 1):
                    for i in range(len(marked) - size + 1):
                        times[lang, size, marked[i : i + size]] += n
            if len(times) > 300_000:
                yield packed(times)
        yield packed(times)

    counted_terms = "lang string, size int, term string, n long"
    with Tables(spark) as tables:
        counts = rows.select("lang", "text").mapInArrow(count, counted_terms).groupBy("lang", "size", "term").agg(F.sum("n").alias("n"))
        terms = spread(tables.save(counts, "language-words")).mapInArrow(cut, counted_terms).groupBy("size", "term", "lang").agg(F.sum("n").alias("n"))
        by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
        found = terms.groupBy("size", "term").agg(F.sum("n").alias("total"), *by_lang).where(F.col("total") >= least).drop("total").toArrow().sort_by([("size", "ascending"), ("term", "ascending")])

    counted = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1) + 0.5
    sizes, names = found.column("size").to_numpy(), found.column("term").to_pylist()
    for size in range(longest + 1):
        counted[sizes == size] /= np.maximum(counted[sizes == size].sum(axis=0), 1)
    logs = np.log(counted)
    table = (logs - logs.max(axis=1, keepdims=True)).astype(np.float32)
    whole = int((sizes == 0).sum())  # words come first
    return Backoff(langs, table, dict(zip(names[:whole], range(whole))), dict(zip(names[whole:], range(whole, len(names)))), longest)


def identify(docs: DataFrame, model: Backoff, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", cells: int = 4_000_000) -> DataFrame:
    """docs less columns named pred_col and score_col, with those two added last; the score is the language's share of the likelihood, 0 to 1.

    `und`, score 0, where the text is null or has no letters. With no language learned, every other text gets `und` too. A task holds about `cells` numbers at a
    time, a language's log frequency of a word each.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(pred_col, score_col)
    n = len(model.langs)
    words_kept, step = cells // max(1, n), max(1, cells // max(1, n))

    def tag_stretch(texts: list[str], rows: dict[str, int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(map(spoken, texts))
        new = list(set(chain.from_iterable(found)).difference(rows))
        table = np.concatenate([table, model.scores(new)])
        rows.update(zip(new, range(len(rows), len(table))))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(map(rows.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        total = np.zeros((len(found), n))
        for at in range(0, len(flat), step):
            mine = owner[at : at + step]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            total[mine[first]] += np.add.reduceat(table[flat[at : at + step]], first, axis=0)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        return table, share.argmax(axis=1), share.max(axis=1) / share.sum(axis=1)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, int] = {}
        table = np.zeros((0, n), np.float32)
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            clear = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts)) & bool(n)
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in stretches(texts, max(1, 4 * cells // max(1, n))) if n else ():
                if len(rows) > words_kept:
                    rows, table = {}, table[:0]
                table, b, s = tag_stretch(part, rows, table)
                best.append(b)
                score.append(s)
            places = np.concatenate(best) if n else np.zeros(len(texts), np.int64)
            pred = [model.langs[b] if ok else UND for b, ok in zip(places, clear)]
            sure = np.where(clear, np.concatenate(score), 0.0) if n else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=[*names, pred_col, score_col])

    names = docs.columns
    schema = StructType([*docs.schema.fields]).add(pred_col, StringType()).add(score_col, DoubleType())
    return spread(docs).mapInArrow(tag, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Null ids are never held out; repeated rows are each predicted; other columns are ignored."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (crc_bucket(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).drop("text")

"""From raw documents to packed sequences: language, toxicity, exact and near duplicates, packing.

Each stage takes the documents that the one before it kept, all of them, and is written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.llm import language_id, toxicity
from medialake.llm.common import Tables, removing, saved, scratch, table, without
from medialake.llm.exact_dedup import exact_dedup
from medialake.llm.ngram_join import ngram_join
from medialake.llm.packing import pack, pieces_of
from medialake.llm.queries import BPE

#: A language is rejected where no letters tell it, or where its share of the likelihood stays below this.
LEAST_SURE = 0.5
#: A document is rejected as toxic from this score.
TOXIC_FROM = 0.7
#: Ids may repeat or be null, so the duplicate stages tell rows apart by this column.
ROW = "pipeline_row"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose language is told; null, empty and letterless texts go. Repeated rows stay or go together."""
    tagged = language_id.identify(docs, language_id.train(docs), pred_col="pipeline_lang_pred", score_col="pipeline_lang_score")
    return tagged.where((F.col("pipeline_lang_pred") != language_id.UND) & (F.col("pipeline_lang_score") >= LEAST_SURE)).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose score is below TOXIC_FROM. Null and empty texts get the score of no evidence; repeated rows stay or go together; null ids are scored like others."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    tagged = toxicity.tag(docs, model, score_col="pipeline_toxic_score", spans_col=None)
    return tagged.where(F.col("pipeline_toxic_score") < TOXIC_FROM).select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written, so that every read gives a row the same number, and the column's name."""
    name = ROW
    while name in docs.columns:
        name += "_"
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal normalised texts, one row, of the smallest doc_id, whatever ids and rows repeat; a null id only where there is no other. Null and empty texts are equal."""
    rows, row = numbered(docs)
    said = exact_dedup(rows, row_col=row)
    return without(rows, saved(said.where("NOT kept").select(row), "pipeline-copies"), row).select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near duplicates, one row, of the smallest doc_id, whatever ids and rows repeat; a null id only where there is no other. Texts without words all stay."""
    rows, row = numbered(docs)
    said = ngram_join(rows, row_col=row)
    return without(rows, saved(said.where("NOT kept").select(row), "pipeline-near"), row).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. A null or empty text is the end id alone; rows that repeat are packed each for itself."""
    return pack(pieces_of(docs, BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("exact_dedup", no_copies),
    ("ngram_join", no_near_copies),
    ("packing", packed),
]

#: Learned models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. Each stage's documents are written in the shared folder, and those before it, and what led to them, removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with removing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            Tables(spark).remove(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

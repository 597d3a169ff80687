"""The corpus pipeline: five stages over the documents table, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs. All but the last keep the columns of documents.

Rows are told apart by (doc_id, text hash): rows that agree in both stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, near_dedup, token_ids
from tessera.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a text whose best language has a smaller share of its words is rejected as unidentified
MIN_LANGUAGE_SCORE = 0.35
#: words a worker keeps the ids of: fewer than op5 keeps, since the executors' heaps have grown in the stages
#: before (with 1 000 000 an executor took more than 3000 MB, with 300 000 it peaks at 2117 MB)
CACHE_WORDS = 300_000


def _rows(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Rows of docs whose (doc_id, text hash) is (left_semi) or is not (left_anti) in marks."""
    m = marks.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    # the text hash comes first: the equality that spreads rows, null ids included
    return docs.join(m, (F.xxhash64("text") == F.col("_th")) & docs["doc_id"].eqNullSafe(F.col("_id")), how).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in which no language prevails."""
    rest = tuple(c for c in COLUMNS if c != "doc_id")
    labelled = language_id.predict(docs, language_id.fit(docs), keep=rest)
    return labelled.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group (five-word shingles, 0.8)."""
    found = near_dedup.near_duplicates(docs)
    return _rows(docs, found.where(~F.col("kept")), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return _rows(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets."""
    return mixing.copies(docs, mixing.mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids and read them back."""
    return token_ids.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: model fitting and tokenizing are beyond SQL; tests/llm compares stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

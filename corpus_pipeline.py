"""A corpus pipeline of four stages: drop toxic documents, drop documents without a known language, keep one document of each group of near copies, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from datamove.llm import language_id, ngram_join, packing, toxicity
from datamove.llm.words import text_batches
from datamove.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar does not call toxic."""
    text_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    text_batches(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity of 0.8 or more over five-word shingles, the one with the smallest id (null ids last, then by text
    hash). A document is an id and its text: an id may repeat with another text, or be null. Rows that repeat a kept document are kept."""
    text_batches(spark)
    return ngram_join.drop_linked(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 tokens."""
    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("ngram_join", drop_copies), ("packing", pack)]
ORACLE_SQL = None  # no stage has an SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each one's rows are written in the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

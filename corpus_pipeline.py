"""A corpus from documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import jaccard, language, line_dedup, mixing, packing
from shelfmark.llm.common import small_batches
from shelfmark.sources.tables import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that `lang` names somewhere; other languages and noise go."""
    small_batches(spark)
    return language.keep_known(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; `n_chars` counts what is left."""
    small_batches(spark)
    return line_dedup.clean(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, shuffled."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs, packing.vocabulary(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("line_dedup", without_repeated_lines),
    ("jaccard", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Rank-order profiles, hashes and tokens have no SQL form; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

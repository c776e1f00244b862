"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    alignment,
    hard_negatives,
    html_text,
    jaccard,
    language,
    licenses,
    line_dedup,
    mixing,
    neighbours,
    packing,
    quality,
    scoring,
    vector_dedup,
)
from shelfmark.llm.common import fold, small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), packing.vocabulary())


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(fold(docs, 4) == 2, F.lit(False)))
    profiles = language.learn(docs.where("NOT held_out"))
    return language.predict(docs.drop("lang"), profiles).drop("text")


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(docs, 7) == 2, F.lit(False))
    scored = scoring.score(docs, scoring.train(docs.where(~held_out).select("text")))
    return scored.withColumn("held_out", F.coalesce(fold(scored, 7) == 2, F.lit(False)))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "html"))
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")))
    return text.select("page_id", "text", F.length("text").alias("n_chars"), lines.alias("n_lines"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(_read(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(fold(docs, 5) == 0, F.lit(False))
    model = quality.learn(docs.where(~held_out), labels.where(~F.coalesce(fold(labels, 5) == 0, F.lit(False))))
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_scoring": op5_scoring,
    "op6_neighbours": op6_neighbours,
    "op7_html_text": op7_html_text,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality": op12_quality,
    "op13_alignment": op13_alignment,
}

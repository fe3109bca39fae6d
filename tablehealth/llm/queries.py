"""The queries over the test tables that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.llm import (
    alignment,
    bpe,
    conversations,
    hamming,
    langid,
    line_dedup,
    ngrams,
    packing,
    pii,
    quality,
    sentencepieces,
    simhash,
    toxicity,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its text cleaned of lines that many sites share."""
    return line_dedup.clean(_documents(spark, folder)).select("doc_id", "text", "removed_lines")


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.classes(_documents(spark, folder)).select(
        "doc_id",
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(_documents(spark, folder))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.score(_documents(spark, folder), labels)


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(_documents(spark, folder))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return pii.spans(_documents(spark, folder))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document, by all n-grams of the training texts."""
    return ngrams.score(_documents(spark, folder), min_count=1)


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    return bpe.digests(_documents(spark, folder))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(_documents(spark, folder)).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept"
    )


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows of every twentieth row, by sign codes."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = hamming.search(rows, rows.where("vec_id % 20 = 0"), 10, "vec_id", "embedding")
    return found.withColumnRenamed("id", "vec_id")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens of two tokenizers aligned, with how common its links are."""
    return alignment.scores(_documents(spark, folder))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by a checksum."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    return conversations.report(conversations.damaged(rows), rows)


def op13_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's piece ids and of the text they decode to."""
    return sentencepieces.digests(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_alignment": op11_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sentencepiece": op13_sentencepiece,
}

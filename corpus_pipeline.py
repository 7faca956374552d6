"""Cleaning pipeline over ``documents``: five stages, each reading what the one
before it wrote.

    language     documents in a language of the corpus stay
    duplicates   one document of each group of near duplicates stays
    benchmark    documents that hold a benchmark window go
    secrets      secrets are masked in the texts that hold them
    packing      the rest is tokenised and packed into sequences

The first four return the columns of ``documents``; the last one the pieces and
their places. Every stage takes all rows that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantscope.llm import decontam, language_id, ngram_jaccard, packing, secret_scan
from tenantscope.session import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns of these names out of an operator's way,
    and the columns that bring all of ``docs`` back under its names."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts that are unlike every language:
    further from the nearest profile than ``language_id.REJECT_DISTANCE``.
    Profiles are learned from the documents of ``docs`` that are not held out."""
    learned = language_id.profiles(docs.where(~language_id.held_out()))
    src, own = _apart(docs, {"lang_pred", "score", "distance"})
    judged = language_id.predict(src, learned)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("distance") <= language_id.REJECT_DISTANCE)) \
        .select(*own)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links at a similarity of 0.8 of
    five-word shingles."""
    return ngram_jaccard.one_of_each_group(docs, words=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    src, own = _apart(docs, {"n_words", "hits", "items", "near_items"})
    return decontam.benchmark_hits(src, items, near_terms=0).where(F.size("hits") == 0).select(*own)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; n_chars follows the new text."""
    src, own = _apart(docs, {"secrets"})
    found = secret_scan.find_secrets(src, secret_scan.fit(docs))
    masked = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return masked.select(*own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [("language", language), ("duplicates", duplicates), ("benchmark", benchmark),
                                   ("secrets", secrets), ("packing", pack)]
#: Learned profiles, components, a trained network and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared
    folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

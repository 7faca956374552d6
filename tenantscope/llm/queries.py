"""Registered queries of the training-data operators: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (ann, decontam, html_text, language_id, ngram_jaccard, packing, prefix_trie, secret_scan,
               suffix_dedup, token_output, url_filters, warc, whitening)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(fn, *names: str):
    """A query over whole tables."""
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))


QUERIES = {
    "op1_suffix_array_dedup": (_over(suffix_dedup.op1_suffix_array_dedup, "documents"), suffix_dedup.ORACLE),
    "op2_ngram_jaccard_join": (_over(ngram_jaccard.op2_ngram_jaccard_join, "documents"), ngram_jaccard.ORACLE),
    "op3_token_output": (_over(token_output.op3_token_output, "documents"), None),
    "op4_url_filters": (_over(url_filters.op4_url_filters, "pages"), url_filters.ORACLE),
    "op5_nearest_neighbours": (_over(ann.op5_nearest_neighbours, "embeddings"), None),
    "op6_secret_scan": (_over(secret_scan.op6_secret_scan, "documents"), None),
    "op7_best_fit_packing": (_over(packing.op7_best_fit_packing, "documents"), None),
    "op8_html_extraction": (_over(html_text.op8_html_extraction, "pages"), None),
    "op9_language_id": (_over(language_id.op9_language_id, "documents"), None),
    "op10_decontamination": (_over(decontam.op10_decontamination, "documents", "benchmark"), decontam.ORACLE),
    "op11_prefix_trie": (_over(prefix_trie.op11_prefix_trie, "conversations"), prefix_trie.ORACLE),
    "op12_warc": (_over(warc.op12_warc, "pages"), warc.ORACLE),
    "op13_embedding_whitening": (_over(whitening.op13_embedding_whitening, "embeddings"), None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}

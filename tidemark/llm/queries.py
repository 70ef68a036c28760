"""The operators applied to the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, minhash, mixing, negatives, prefixes, quality, secret_scan, simhash, spellings, suffixes, tokens, toxicity, urls
from tidemark.llm.sql import SQL  # noqa: F401  (beside the queries, for the entry file)

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_versions(_table(spark, folder, "documents"), "doc_id", "text")[0]


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.edited_neighbours(_table(spark, folder, "documents"), "doc_id", "text")


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), "doc_id", "text")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/word_bpe_49k.json", 2048)


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), "doc_id", "text", "source")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), "doc_id", "text")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), "doc_id", "text")


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, folder, "documents"), "doc_id", "text")


def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), "page_id", "url")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.report(decontaminate.mark_hits(docs, "doc_id", "text", items, "item_id", "text"), "doc_id")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh being shifted by one."""
    label = F.col("label").cast("bigint")
    rows = _table(spark, folder, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding")


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles agree to 90 % or more."""
    return prefixes.join_components(_table(spark, folder, "documents"), "doc_id", "text", 3, 90)


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents, every 31st noted with a letter left out."""
    return spellings.variants(spellings.vocabulary(_table(spark, folder, "documents"), "doc_id", "text", every=31))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_document_fingerprints, op3_minhash_near_dedup, op4_token_counts, op5_source_mixing,
    op6_quality_classifier, op7_toxicity, op8_suffix_array_dedup, op9_url_filters, op10_benchmark_decontamination,
    op11_hard_negatives, op12_ngram_join, op13_spelling_variants,
)}

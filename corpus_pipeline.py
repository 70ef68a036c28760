"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, mixture.

Each stage is given the documents that the one before it kept and returns the documents it keeps, whole and with all
columns; the last returns the uses of the documents in the mixture. Stages meet in tables in the shared folder, so a
lost executor costs the work of its tasks only.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash, mixing, quality, secret_scan
from tidemark.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"), "doc_id", "text")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id; of rows with one id the least text digest."""
    return minhash.one_of_each(docs, "doc_id", "text")


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; those that are half passages go."""
    return decontaminate.decontaminate(docs, "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def secretless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret that the scan finds cut out of the text."""
    return secret_scan.without_secrets(docs, "doc_id", "text")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The uses of each document in the flattest mixture of sources that repeats none more than twice."""
    return mixing.mix(docs, "doc_id", "text", "source")


STAGES = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("secret scans", secretless_documents),
    ("mixing sources", mixed_documents),
]

ORACLE_SQL = None  # a network, signatures and permutations; the tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    steps = [functools.partial(function, spark) for _, function in STAGES]
    for step in steps[:-1]:
        docs = stored(step(docs, sf_dir), "pipeline")
    return stored(steps[-1](docs, sf_dir), "pipeline")

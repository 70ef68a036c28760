"""Metric samples and audit events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The labels of a metric sample in long form.
LABELS = ("topic", "consumer_group_id", "partition", "connector", "statement_name", "state", "le")

METRIC_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    *[T.StructField(label, T.StringType()) for label in LABELS],
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("principal", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("resource", T.StringType()),
    T.StructField("result", T.StringType()),
])

# The kinds of audit events that are delivered.
AUDIT_KINDS = ("authentication", "authorization", "schema", "config", "role-binding")


def read_metrics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Metric samples in long form with a fixed schema."""
    return spark.read.format(fmt).schema(METRIC_SCHEMA).load(path)


def to_samples(df: DataFrame, metric: str, time: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Rows of any table as metric samples."""
    return df.select(
        F.lit(metric).alias("metric"), *labels, F.col(time).alias("ts"), F.col(value).cast("double").alias("value")
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines with a fixed schema; ``kind`` is the event's first name part."""
    return audit_kinds(spark.read.schema(AUDIT_SCHEMA).json(path))


def audit_kinds(audit: DataFrame, event: str = "event") -> DataFrame:
    kind = F.split(F.col(event), "\\.").getItem(0)
    return audit.withColumn("kind", F.when(kind.isin(*AUDIT_KINDS), kind).otherwise("other"))

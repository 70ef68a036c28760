"""Topic streams, typed decoding, and event-time declarations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.units import instant
from tidemark.operators.errors import split_decodable
from tidemark.operators.windows import with_event_time
from tidemark.sources.schemas import with_defaults

_WIRE_HEADER_BYTES = 5


def kafka_options(
    servers: str, topic: str | None = None, pattern: str | None = None, start: str = "latest",
    max_per_batch: int | None = None,
) -> dict[str, str]:
    """Options of a Kafka stream read. The connector is a separate package; untested here."""
    if (topic is None) == (pattern is None):
        raise ValueError("give a topic or a pattern")
    options = {"kafka.bootstrap.servers": servers, "startingOffsets": start}
    options["subscribe" if topic else "subscribePattern"] = topic or pattern
    if max_per_batch:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def read_topic(
    spark: SparkSession,
    location: str,
    schema: T.StructType | str,
    start: str | datetime = "earliest",
    fmt: str = "parquet",
    max_per_batch: int | None = None,
) -> DataFrame:
    """A topic kept as files, read as a stream with a fixed schema.

    ``start`` is ``earliest`` or a time after which files count; a query that restarts passes the time it first
    started at. "Latest" is not offered: it would mean another time after a restart, and files that came meanwhile
    would be lost. ``max_per_batch`` bounds the files of one micro-batch.
    """
    if start != "earliest" and not isinstance(start, datetime):
        raise ValueError(f"unknown start {start!r}")
    reader = spark.readStream.format(fmt).schema(schema)
    if max_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_per_batch)
    topic = reader.load(location)
    if start == "earliest":
        return topic
    return topic.filter(F.col("_metadata.file_modification_time") > instant(start))


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    """Kafka topic stream: key, value, topic, partition, offset, timestamp, headers."""
    return spark.readStream.format("kafka").options(**kafka_options(**options)).option("includeHeaders", "true").load()


def decode_values(df: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with typed columns, rows that failed to decode) from JSON values; a bad record fails no job."""
    good, bad = split_decodable(df, schema, value, "_decoded")
    typed = good.select(*[c for c in df.columns if c != value], "_decoded.*")
    return with_defaults(typed, schema), bad


def decode_framed_avro(df: DataFrame, document: str, value: str = "value") -> DataFrame:
    """Registry-framed Avro values to typed columns; needs Spark's Avro package. Untested here."""
    from pyspark.sql.avro.functions import from_avro

    body = F.expr(f"substring({value}, {_WIRE_HEADER_BYTES + 1})")
    return df.withColumn("_decoded", from_avro(body, document, {"mode": "PERMISSIVE"})).select(
        *[c for c in df.columns if c != value], "_decoded.*"
    )


def declare_stream(
    df: DataFrame, schema: T.StructType, event_time: str, delay: str = "5 seconds", key: Sequence[str] | None = None
) -> DataFrame:
    """Typed columns, event time and watermark. The key is checked to exist but not enforced to be unique."""
    missing = [c for c in [*(key or []), event_time] if c not in schema.names]
    if missing:
        raise ValueError(f"columns not declared: {missing}")
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return with_event_time(typed, event_time, delay)


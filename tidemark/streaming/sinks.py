"""Outputs of streams and batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.names import dead_letter_topic
from tidemark.operators.errors import split_decodable
from tidemark.operators.routing import mirror, route
from tidemark.streaming.run import run_stream, run_to_parquet
from tidemark.streaming.tables import write_batch

Handler = Callable[[DataFrame, int], None]

# Fixed value: flush interval of the lakehouse sink.
FLUSH_INTERVAL = "5 seconds"


def to_records(df: DataFrame, topic: str | Column, key: str) -> DataFrame:
    """Rows as keyed records: topic, key text, JSON value with every column."""
    name = topic if isinstance(topic, Column) else F.lit(topic)
    return df.select(
        name.alias("topic"), F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"),
    )


def write_topic(df: DataFrame, topic: str, key: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append keyed records to a topic kept as a folder."""
    return run_to_parquet(to_records(df, topic, key), path, checkpoint, interval)


def write_kafka(df: DataFrame, topic: str, key: str, servers: str, checkpoint: str) -> StreamingQuery:
    """Append keyed records to a Kafka topic. The connector is a separate package; untested here."""
    records = to_records(df, topic, key)
    writer = records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("checkpointLocation", checkpoint).start()


def append_lakehouse(df: DataFrame, path: str, checkpoint: str, flush: str | None = FLUSH_INTERVAL, **kw) -> StreamingQuery:
    """Append every flush interval; ``flush=None`` appends what is there and ends."""
    return run_to_parquet(df, path, checkpoint, flush, **kw)


def materialize_topic(df: DataFrame, topic: str, root: str, checkpoint: str, time: str | None = None,
                      interval: str | None = "60 seconds") -> StreamingQuery:
    """Append a topic to its table: the topic name with underscores for dots, partitioned by day."""
    path = f"{root}/{topic.replace('.', '_')}"
    if time is None:
        return run_to_parquet(df, path, checkpoint, interval)
    return run_to_parquet(df.withColumn("day", F.to_date(time)), path, checkpoint, interval, ("day",))


def many_outputs(routes: Mapping[str, Column], path: str) -> Handler:
    """Several outputs from one read: a row is written once for each route it satisfies.

    One write with the route as partition column, so neither a cache nor a scan per output is needed.
    """
    return lambda batch, batch_id: write_batch(route(batch, routes), path, batch_id, ["route"])


def write_many(df: DataFrame, routes: Mapping[str, Column], path: str, checkpoint: str, interval=None) -> StreamingQuery:
    return run_stream(df, many_outputs(routes, path), checkpoint, interval)


def with_dead_letters(
    schema: T.StructType, value: str, good_path: str, bad_path: str, family: str, sink: str
) -> Handler:
    """Write decodable rows to the sink and the others to its dead-letter table with their context."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_decodable(batch, schema, value, "_d")
            write_batch(good.select(*[c for c in batch.columns if c != value], "_d.*"), good_path, batch_id)
            context = F.create_map(
                F.lit("error.type"), F.lit("SERIALIZATION"), F.lit("sink"), F.lit(sink),
                F.lit("batch"), F.lit(str(batch_id)),
            )
            out = bad.withColumns({"dlq_topic": dead_letter_topic(family, F.lit(sink)), "headers": context})
            write_batch(out, bad_path, batch_id)
        finally:
            batch.unpersist()

    return handle


def write_dlq(df: DataFrame, schema: T.StructType, value: str, root: str, family: str, sink: str, checkpoint: str,
              interval: str | None = None) -> StreamingQuery:
    handler = with_dead_letters(schema, value, f"{root}/good", f"{root}/dead", family, sink)
    return run_stream(df, handler, checkpoint, interval)


def audit_copies(df: DataFrame, targets: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Every audit event once per consumer, with that consumer's source and source type."""
    copies = F.array(*[
        F.struct(F.lit(name).alias("target"), F.lit(t["source"]).alias("source"), F.lit(t["sourcetype"]).alias("sourcetype"))
        for name, t in targets.items()
    ])
    return df.withColumn("_c", F.explode(copies)).select("*", "_c.*").drop("_c")


def publish_audit(df: DataFrame, targets: Mapping[str, Mapping[str, str]], path: str, checkpoint: str, interval=None):
    """Deliver all audit events to all consumers' tables in one write."""
    return run_stream(
        df, lambda batch, i: write_batch(audit_copies(batch, targets), path, i, ["target"]), checkpoint, interval
    )


def mirror_stream(df: DataFrame, alias: str, path: str, checkpoint: str, exclude: Sequence[str] | None = None,
                  interval: str | None = None) -> StreamingQuery:
    """Copy topics to the other region under their prefixed names."""
    rows = mirror(df, alias, exclude) if exclude is not None else mirror(df, alias)
    return run_to_parquet(rows, path, checkpoint, interval)

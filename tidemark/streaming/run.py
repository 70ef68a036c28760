"""Starting checkpointed queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Checkpoint cadence by environment.
CHECKPOINT_INTERVAL = {"default": "60 seconds", "prod": "30 seconds"}


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk, in the RocksDB provider that ships with Spark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def run_stream(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None,
    mode: str = "append", name: str | None = None,
) -> StreamingQuery:
    """Feed micro-batches to ``handle(batch, batch_id)``.

    A batch may be delivered again after a failure, with the same id; the sinks of this package
    overwrite what an earlier delivery of that id wrote. Without ``interval`` the query reads what is
    there and ends.
    """
    writer = df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**_trigger(interval)).start()


def run_to_parquet(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = None, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append to a parquet folder; Spark's file sink records each batch, so restarts add nothing twice."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.outputMode("append").trigger(**_trigger(interval)).start()


def drained(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query that ends by itself; its failure is raised here."""
    query.awaitTermination()
    return query


def replayed(df: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over what is there and return the written result as a table."""
    spark = df.sparkSession
    root = fresh_path(spark, name)
    drained(run_to_parquet(df, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def fed_in_parts(parts: Sequence[DataFrame], start: Callable[[DataFrame, str], StreamingQuery], name: str) -> str:
    """Write each part as new files of one folder and start the stream again until it has read them.

    ``start`` gets the folder read as a stream and a folder for results and checkpoint, which is returned.
    """
    spark = parts[0].sparkSession
    root = fresh_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        drained(start(spark.readStream.schema(part.schema).parquet(f"{root}/in"), root))
    return root


def replayed_in_parts(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Feed a stream that ``build`` makes part by part; returns what it wrote as a table."""
    schema = []

    def start(raw: DataFrame, root: str) -> StreamingQuery:
        result = build(raw)
        schema.append(result.schema)
        return run_to_parquet(result, f"{root}/out", f"{root}/checkpoint")

    root = fed_in_parts(parts, start, name)
    return parts[0].sparkSession.read.schema(schema[0]).parquet(f"{root}/out")

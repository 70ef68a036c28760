"""Session construction and the shared folder that jobs write working tables to."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_marked: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and benchmarks; on a cluster use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for working tables, which goes when the application ends.

    It is in the folder named by ``spark.checkpoint.dir``; where that is unset, in the warehouse folder, which the
    executors share as well.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    parent = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    folder = f"{parent}/working-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)  # only what exists can be marked
        store.deleteOnExit(at)
        _marked.add(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used by an earlier run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listed(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table of values known here. It is a local relation, so Spark knows its size when it plans joins."""
    return spark.createDataFrame(pa.table(columns), schema=schema)


# Rows that one task takes of a shuffle whose number of rows is known.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The same rows dealt by keys over as many tasks as their number asks for; as they are, if that is one.

    Adaptive execution joins partitions by their bytes on disk, of which a small row has few, so that a task which sorts or
    counts them in memory grows with the input.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else df


def durable(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared folder.

    For results that are read more than once and cost more to compute than to read. Readers prune the
    columns they do not use, and a lost executor costs nothing but its own tasks.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Which rows of a stream came late, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.units import micros


class LateSplit:
    """A handler for ``run_stream`` that keeps every row of a stream with ``late``: whether the watermark had passed it.

    The watermark of a batch is the newest time of all batches before it, less ``delay``, to the microsecond; the first batch has none. A
    row older than that is late; one without a time is not. Rows go into ``late=true`` and ``late=false`` folders of their batch, and the
    newest time so far into a row beside them, from which the next batch and a restart go on. A batch that
    is delivered again finds the same mark and overwrites the same folders.
    """

    def __init__(self, path: str, time: str, delay: str | int) -> None:
        self.path, self.time, self.delay = path, time, micros(delay)

    def _mark(self, spark: SparkSession, batch_id: int) -> int | None:
        """The newest time of all batches before this one."""
        if not batch_id:
            return None
        return spark.read.schema("us bigint").parquet(f"{self.path}/marks/{batch_id - 1}").first()["us"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = self._mark(spark, batch_id)
        us = F.unix_micros(self.time)
        late = F.lit(False) if mark is None else F.coalesce(us < F.lit(mark - self.delay), F.lit(False))
        rows = batch.withColumn("late", late)
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{self.path}/rows/batch={batch_id}")
        written = spark.read.schema(batch.schema).parquet(f"{self.path}/rows/batch={batch_id}")
        newest = written.agg(F.greatest(F.max(us), F.lit(mark).cast("bigint")).alias("us"))
        newest.write.mode("overwrite").parquet(f"{self.path}/marks/{batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All rows with ``late``; a filter on it prunes folders."""
        whole = spark.read.option("basePath", f"{self.path}/rows").schema(f"{schema.toDDL()}, batch bigint, late boolean").parquet(f"{self.path}/rows")
        return whole.drop("batch")

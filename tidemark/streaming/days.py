"""A stream's table by tier and day, from which retention drops whole days."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.units import instant
from tidemark.operators.retention import apply_retention, retention_millis
from tidemark.session import listed

_DAY_MS = 86400000
_NULL = "__HIVE_DEFAULT_PARTITION__"


class DayTable:
    """A handler for ``run_stream``: rows in folders by tier, day (UTC) and batch; a batch that is delivered again overwrites its own.

    ``expire`` has the result of ``apply_retention``: days that are over for their tier go as folders, without a row being read, and
    only the day that the limit falls into is written again. Call it between batches, not beside one.
    """

    def __init__(self, path: str, time: str, tier: str) -> None:
        self.path, self.time, self.tier = path, time, tier

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"day": F.to_date(self.time), "batch": F.lit(batch_id).cast("long")})
        self._write(rows, self.path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.tier, "day", "batch").parquet(path)

    def _rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        whole = T.StructType([f for f in schema if f.name != self.tier]).add(self.tier, T.StringType()).add("day", T.DateType()).add("batch", T.LongType())
        return spark.read.schema(whole).parquet(self.path)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows with the columns of the batches, ``schema``."""
        return self._rows(spark, schema).select(*schema.names)

    def _days(self, spark: SparkSession, folder: str) -> list[tuple[str, str]]:
        """Names of the (tier, day) folders."""
        fs, at = _store(spark, folder)
        if not fs.exists(at):
            return []
        tiers = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return [
            (t, s.getPath().getName()) for t in tiers if t.startswith(f"{self.tier}=")
            for s in fs.listStatus(_store(spark, f"{folder}/{t}")[1]) if s.isDirectory()
        ]

    def expire(self, spark: SparkSession, schema: T.StructType, now: datetime | Column, compliance_years: int = -1) -> tuple[int, int]:
        """Remove what is older than its tier keeps it at ``now``; returns how many days were dropped and how many written again.

        Rows without a time go unless their tier keeps for ever. If a call fails half-way, the next one first puts in place what it had written.
        """
        self._recover(spark)
        names = self._days(spark, self.path)
        if not names:
            return 0, 0
        value = lambda name: None if name.endswith(f"={_NULL}") else unquote(name.split("=", 1)[1])
        days = listed(spark, {
            "at": list(range(len(names))), "tier": [value(t) for t, _ in names], "day": [value(d) for _, d in names],
        }, "at bigint, tier string, day string")
        keep, start = retention_millis("tier", compliance_years), F.unix_date(F.to_date("day")).cast("long") * _DAY_MS
        now_ms = F.unix_millis(instant(now))
        over = F.coalesce(now_ms - (start + (_DAY_MS - 1)) > keep, F.lit(True))
        found = days.filter(keep != -1).select("at", over.alias("over"), F.coalesce(now_ms - start > keep, F.lit(True)).alias("old")).filter("old").collect()
        edges = [names[r["at"]] for r in found if not r["over"]]
        for row in found:
            if row["over"]:
                self._remove(spark, "/".join((self.path, *names[row["at"]])))
        if edges:
            touched = None
            for tier, day in edges:  # one limit, so one day, for each tier
                one = F.col(self.tier).eqNullSafe(F.lit(value(tier))) & (F.col("day") == F.lit(value(day)).cast("date"))
                touched = one if touched is None else touched | one
            kept = apply_retention(self._rows(spark, schema).filter(touched), self.time, self.tier, now, compliance_years)
            self._write(kept, f"{self.path}/_edge/new")
            for edge in edges:
                self._move(spark, "/".join((self.path, *edge)), "/".join((self.path, "_edge/old", *edge)))
            self._recover(spark)
        return len(found) - len(edges), len(edges)

    def _recover(self, spark: SparkSession) -> None:
        """Put the rewritten days in the place of those that were moved away."""
        for edge in self._days(spark, f"{self.path}/_edge/old"):
            target, fresh = "/".join((self.path, *edge)), "/".join((self.path, "_edge/new", *edge))
            fs, at = _store(spark, target)
            if not fs.exists(at) and fs.exists(_store(spark, fresh)[1]):
                self._move(spark, fresh, target)
        self._remove(spark, f"{self.path}/_edge")

    def _move(self, spark: SparkSession, source: str, target: str) -> None:
        fs, at = _store(spark, target)
        fs.mkdirs(at.getParent())
        if not fs.rename(_store(spark, source)[1], at):
            raise OSError(f"{source} could not be moved to {target}")

    def _remove(self, spark: SparkSession, folder: str) -> None:
        fs, at = _store(spark, folder)
        fs.delete(at, True)


def _store(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

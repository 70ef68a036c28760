"""Named queries over the given tables, each with the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Tables:
    """The given parquet tables; times without zone are read as UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.raw(name)
        zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


@dataclass(frozen=True)
class Plan:
    name: str
    operators: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


PLANS: dict[str, Plan] = {}


def plan(name: str, operators: str, sql: str | None = None):
    """Register a query under ``name`` for the listed operators."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")
        PLANS[name] = Plan(name, tuple(operators.split()), build, sql)
        return build

    return register

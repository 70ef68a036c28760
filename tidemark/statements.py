"""User-submitted SQL over named tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_statement(
    spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None, catalog: str | None = None,
    database: str | None = None,
) -> DataFrame:
    """Run one statement with the given views, catalog and database. Views may be streams."""
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if database:
        spark.catalog.setCurrentDatabase(database)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)

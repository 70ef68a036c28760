"""Change events of databases as rows, and incremental polling."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tidemark.functions.units import instant
from tidemark.session import durable


def flatten_change(df: DataFrame, deletes: str = "rewrite", tombstones: str = "keep") -> DataFrame:
    """New row state of before/after envelopes (``op``, ``before``, ``after``).

    ``rewrite`` turns deletes into their last state with ``deleted`` true, ``drop`` leaves them out.
    A null ``op`` is a tombstone: its columns are null and it is kept or dropped.
    """
    if deletes not in ("rewrite", "drop") or tombstones not in ("keep", "drop"):
        raise ValueError("unknown delete or tombstone handling")
    if deletes == "drop":
        df = df.filter(F.col("op").isNull() | (F.col("op") != "d"))
    if tombstones == "drop":
        df = df.filter(F.col("op").isNotNull())
    state = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    rest = [c for c in df.columns if c not in ("op", "before", "after")]
    return df.select(*rest, state.alias("_s"), (F.col("op") == "d").alias("deleted")).select(*rest, "_s.*", "deleted")


def flatten_document_change(df: DataFrame, document: str = "full_document", key: str = "document_key") -> DataFrame:
    """Document change events as rows: insert, update, replace and delete by document id, drop without one.

    Updates carry the whole document; a delete has only its id.
    """
    rest = [c for c in df.columns if c not in (document, key)]
    fields = [f.name for f in df.schema[document].dataType.fields if f.name != "_id"]
    doc_id = F.coalesce(F.col(f"{document}._id"), F.col(f"{key}._id"))
    return df.select(
        *rest, doc_id.alias("document_id"), *[F.col(f"{document}.{f}").alias(f) for f in fields],
        F.col("operation").isin("delete", "drop").alias("deleted"),
    )


def read_changefeed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data rows, resolved rows) of wrapped feed messages ``before, after, updated, resolved``."""
    rest = [c for c in df.columns if c not in ("before", "after", "resolved")]
    fields = [f.name for f in df.schema["after"].dataType.fields]
    state = F.coalesce(F.col("after"), F.col("before"))
    data = df.filter(F.col("resolved").isNull()).select(
        *rest, *[state[f].alias(f) for f in fields], F.col("after").isNull().alias("deleted")
    )
    origin = [c for c in ("topic", "table", "stream") if c in df.columns]
    return data, df.filter(F.col("resolved").isNotNull()).select(*origin, "resolved")


def replay_from(df: DataFrame, version: str, cursor) -> DataFrame:
    """Changes at or after a point in time, for reconstruction."""
    return df.filter(F.col(version) >= (cursor if isinstance(cursor, Column) else F.lit(cursor)))


def poll_increment(
    table: DataFrame, ts_col: str, id_col: str, last: Mapping | Row | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows strictly after the last (timestamp, id) pair, one-row table with the next pair).

    ``last`` has ``ts`` and ``id``; without it everything is read. Deletes are not seen. The next pair is fixed (and
    written) before the rows are read, and bounds them: a row that arrives in between is above it and comes with the
    next poll. The predicate is a plain comparison, so it is pushed to a JDBC or parquet scan. Rows without a time
    have no position and are read with the first poll only.
    """
    rows = table
    if last is not None and last["ts"] is not None:
        since = last["ts"]
        ts = (instant(since) if isinstance(since, datetime) else F.lit(since)).cast(table.schema[ts_col].dataType)
        i = F.lit(last["id"]).cast(table.schema[id_col].dataType)
        rows = table.filter((F.col(ts_col) >= ts) & ((F.col(ts_col) > ts) | (F.col(id_col) > i)))
    mark = F.max(F.struct(F.col(ts_col).alias("ts"), F.col(id_col).alias("id")))
    position = durable(rows.agg(mark.alias("_m")).select("_m.*"), "position")
    end_ts, end_id = position.select("ts").scalar(), position.select("id").scalar()
    upto = (F.col(ts_col) < end_ts) | ((F.col(ts_col) == end_ts) & (F.col(id_col) <= end_id))
    return rows.filter(upto if last is not None and last["ts"] is not None else upto | F.col(ts_col).isNull()), position


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str, fetch: int = 10240, **options) -> DataFrame:
    """A database table; pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to
    split the read over tasks. Untested here: no database is available."""
    base = {"url": url, "dbtable": table, "driver": driver, "fetchsize": str(fetch)}
    return spark.read.format("jdbc").options(**base, **options).load()


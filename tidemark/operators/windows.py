"""Event time and fixed windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.slices import names


def with_event_time(df: DataFrame, column: str, delay: str = "5 seconds") -> DataFrame:
    """Declare ``column`` as event time with a watermark that trails it by ``delay``."""
    if dict(df.dtypes)[column] != "timestamp":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)


def amount_stats(amount: str, prefix: str = "amount") -> list[Column]:
    """Count, total, average, minimum and maximum; money stays DECIMAL(15,2), rounded half up."""
    money = F.col(amount).cast("decimal(15,2)")

    def fixed(c: Column) -> Column:
        return c.cast("decimal(15,2)")

    return [
        F.count("*").alias("transaction_count"),
        F.sum(money).cast("decimal(25,2)").alias(f"total_{prefix}"),
        # avg() keeps six decimals; the quotient keeps fifteen, so rounding once to cents is exact
        fixed(F.round(F.sum(money) / F.count(money).cast("decimal(20,0)"), 2)).alias(f"avg_{prefix}"),
        fixed(F.min(money)).alias(f"min_{prefix}"),
        fixed(F.max(money)).alias(f"max_{prefix}"),
    ]


def tumbling(
    df: DataFrame, time: str, size: str, aggs: Sequence[Column], keys: str | Sequence[str] = ()
) -> DataFrame:
    """Aggregates per fixed window (and key); windows without rows are not produced.

    The same call serves static tables and streams that went through ``with_event_time``.
    """
    return (
        df.groupBy(F.window(time, size).alias("_w"), *names(keys))
        .agg(*aggs)
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "*")
        .drop("_w")
    )


def timechart(
    df: DataFrame, time: str, span: str, by: str | Sequence[str], agg: Column, pivot: Sequence[str] | None = None
) -> DataFrame:
    """One aggregate per time span and label; ``pivot`` lists labels to lay out as columns."""
    by = names(by)
    grouped = df.groupBy(F.window(time, span).start.alias("span_start"), *([] if pivot else by))
    return grouped.pivot(by[0], list(pivot)).agg(agg) if pivot else grouped.agg(agg)

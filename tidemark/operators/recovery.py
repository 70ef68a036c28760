"""Replication status and recovery drill reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.tiers import TIERS, tier_value, with_tier
from tidemark.functions.units import duration_text, whole_div
from tidemark.operators.alerts import assess_lag


def topic_lags(lags: DataFrame, topic: str = "topic", lag_ms: str = "lag_ms") -> DataFrame:
    """Lag in whole seconds per topic: the slowest partition decides; no lag counts as 0."""
    worst = lags.groupBy(topic).agg(F.max(F.coalesce(F.col(lag_ms), F.lit(0))).alias(lag_ms))
    return worst.withColumn("lag_s", whole_div(F.col(lag_ms).cast("long"), 1000))


def dr_status(lags: DataFrame, topics: DataFrame, topic: str = "topic", lag_ms: str = "lag_ms") -> DataFrame:
    """Topic, tier, lag, alert threshold and status."""
    rated = assess_lag(with_tier(topic_lags(lags, topic, lag_ms), topics, topic))
    return rated.select(topic, "tier", "lag_s", F.col("warn").alias("warn_s"), F.col("alert").alias("threshold_s"), "status")


def lag_summary(status: DataFrame) -> DataFrame:
    """Counts of OK, WARN and ALERT topics and the summary line."""
    counts = status.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "WARN", "ALERT")])
    line = F.format_string("%d topics OK, %d WARN, %d ALERT", "ok", "warn", "alert")
    return counts.withColumn("summary", line)


def failover_risk(status: DataFrame) -> DataFrame:
    """Topics whose lag means data loss on failover."""
    return status.filter(F.col("status") == "ALERT")


def all_synced(status: DataFrame) -> DataFrame:
    """One row: true when every topic is below its warn limit (also when there are none)."""
    return status.agg(F.coalesce(F.bool_and(F.col("lag_s") < F.col("warn_s")), F.lit(True)).alias("all_synced"))


def drill_report(steps: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Steps with their duration; ``result`` stays as recorded."""
    seconds = whole_div(F.unix_micros(end) - F.unix_micros(start), 1000000)
    return steps.withColumn("duration_s", seconds).withColumn("duration", duration_text("duration_s"))


def drill_verdict(steps: DataFrame, by: str | Sequence[str] = (), start="start", end="end", result="result"):
    """Overall verdict (PASS only when every step passed) and total duration."""
    by = [by] if isinstance(by, str) else list(by)
    total = whole_div(F.unix_micros(F.max(end)) - F.unix_micros(F.min(start)), 1000000)
    out = steps.groupBy(*by).agg(
        F.count("*").alias("steps"), F.count_if(F.col(result) == "PASS").alias("passed"),
        F.when(F.bool_and(F.col(result) == "PASS"), "PASS").otherwise("FAIL").alias("verdict"), total.alias("total_s"),
    )
    return out.withColumn("total", duration_text("total_s"))


def case_map(value: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Fixed label per value."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.lit(default))


def assess_upto(value: Column, warn: float, alert: float) -> Column:
    """Label with fixed limits: up to ``warn`` OK, up to ``alert`` WARN, above it ALERT."""
    return F.when(value <= warn, "OK").when(value <= alert, "WARN").otherwise("ALERT")


def rpo_check(df: DataFrame, tier: str = "tier", loss_s: str = "loss_s", outage_s: str = "outage_s") -> DataFrame:
    """Measured data loss and outage against the tier's targets; a zero target allows no loss."""
    standard = TIERS["standard"]
    rpo, rto = tier_value(tier, "rpo_s", standard["rpo_s"]), tier_value(tier, "rto_s", standard["rto_s"])
    return df.withColumns({"rpo_s": rpo.cast("long"), "rto_s": rto.cast("long")}).withColumns({
        "rpo_met": F.when(F.col("rpo_s") == 0, F.col(loss_s) == 0).otherwise(F.col(loss_s) < F.col("rpo_s")),
        "rto_met": F.col(outage_s) < F.col("rto_s"),
    })

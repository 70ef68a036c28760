"""Retention by tier and cleanup policies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.tiers import FALLBACK_SETTINGS, TIERS, checked_years, tier_value
from tidemark.functions.units import instant
from tidemark.operators.changes import compact


def retention_millis(tier: str, compliance_years: int = -1) -> Column:
    """Milliseconds a row of the tier is kept; -1 keeps it for ever."""
    checked_years(compliance_years)
    years = -1 if compliance_years == -1 else compliance_years * 31557600000
    return F.when(F.col(tier) == "compliance", F.lit(years).cast("long")).otherwise(
        tier_value(tier, "retention_ms", FALLBACK_SETTINGS["retention_ms"])
    )


def apply_retention(
    df: DataFrame, time: str, tier: str, now: datetime | Column, compliance_years: int = -1
) -> DataFrame:
    """Drop rows older than their tier keeps them at ``now``; -1 keeps all."""
    keep = retention_millis(tier, compliance_years)
    at = instant(now)
    age = F.unix_millis(at) - F.unix_millis(F.col(time))
    if compliance_years != -1:
        # No tier keeps longer than this; a plain comparison reaches the scan.
        longest = max(compliance_years * 31557600000, *(s["retention_ms"] for s in TIERS.values()))
        oldest = F.timestamp_millis(F.unix_millis(at) - F.lit(longest))
        df = df.filter(F.col(time) >= oldest.cast(df.schema[time].dataType))
    return df.filter((keep == -1) | (age <= keep))


def apply_cleanup(
    df: DataFrame,
    policy: str,
    key: str | Sequence[str] = (),
    order: str | Sequence[str] = (),
    deleted: Column | None = None,
    **retention,
) -> DataFrame:
    """``delete`` applies retention, ``compact`` keeps the latest per key, ``compact,delete`` both."""
    steps = {p.strip() for p in policy.split(",")}
    if not steps <= {"delete", "compact"}:
        raise ValueError(f"unknown cleanup policy {policy!r}")
    if "delete" in steps:
        df = apply_retention(df, **retention)
    return compact(df, key, order, deleted) if "compact" in steps else df

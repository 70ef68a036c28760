"""Service tiers: fixed settings, thresholds and lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_TIER = "standard"

# They must equal the governed platform's constants for results to agree.
TIERS = {
    "critical": {
        "compatibility": "FULL_TRANSITIVE", "partitions": 12, "retention_ms": 604800000, "min_isr": 2,
        "lag_warn_s": 30, "lag_alert_s": 60, "records_warn": 1000, "records_alert": 5000,
        "min_retention_ms": 604800000, "min_partitions": 6, "tasks_sink": 6, "tasks_source": 4,
        "ttl_s": None, "rpo_s": 300, "rto_s": 900,
    },
    "standard": {
        "compatibility": "BACKWARD_TRANSITIVE", "partitions": 6, "retention_ms": 259200000, "min_isr": 2,
        "lag_warn_s": 300, "lag_alert_s": 900, "records_warn": 10000, "records_alert": 50000,
        "min_retention_ms": 259200000, "min_partitions": 3, "tasks_sink": 3, "tasks_source": 2,
        "ttl_s": 86400, "rpo_s": 7200, "rto_s": 3600,
    },
    "best-effort": {
        "compatibility": "BACKWARD", "partitions": 3, "retention_ms": 86400000, "min_isr": 1,
        "lag_warn_s": 3600, "lag_alert_s": 14400, "records_warn": 100000, "records_alert": 500000,
        "min_retention_ms": 86400000, "min_partitions": 1, "tasks_sink": 1, "tasks_source": 1,
        "ttl_s": 3600, "rpo_s": 86400, "rto_s": 14400,
    },
    "compliance": {
        "compatibility": "FULL_TRANSITIVE", "partitions": 12, "retention_ms": -1, "min_isr": 2,
        "lag_warn_s": 10, "lag_alert_s": 30, "records_warn": 500, "records_alert": 2000,
        "min_retention_ms": 220898482000, "min_partitions": 3, "tasks_sink": 6, "tasks_source": 4,
        "ttl_s": None, "rpo_s": 0, "rto_s": 900,
    },
}

# Used by the settings lookups when the tier itself is not known.
FALLBACK_SETTINGS = {
    "compatibility": "BACKWARD", "partitions": 6, "retention_ms": 259200000, "tasks_sink": 3, "tasks_source": 3,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known_tier(tier: Column | str) -> Column:
    return F.coalesce(_col(tier).isin(list(TIERS)), F.lit(False))


def tier_or_default(tier: Column | str) -> Column:
    """The tier, or ``standard`` when it is null or empty."""
    t = _col(tier)
    return F.when(t.isNull() | (t == ""), F.lit(DEFAULT_TIER)).otherwise(t)


def checked_years(years: int) -> int:
    """Years a compliance record is kept: at least seven, or -1 for ever."""
    if years != -1 and years < 7:
        raise ValueError("compliance retention must be -1 or at least 7 years")
    return years


def tier_value(tier: Column | str, name: str, default=None, strict: bool = False) -> Column:
    """One setting of a tier as an inline lookup (no join).

    Other tiers give ``default``, or fail the job with ``strict``.
    """
    if name not in TIERS[DEFAULT_TIER]:
        raise ValueError(f"unknown tier setting {name!r}")
    t, out = _col(tier), None
    for tier_name, settings in TIERS.items():
        value = F.lit(settings[name])
        value = value.cast("long") if name.endswith(("_ms", "_s")) else value
        out = F.when(t == tier_name, value) if out is None else out.when(t == tier_name, value)
    if strict:
        return out.when(known_tier(t), F.lit(None)).otherwise(
            F.raise_error(F.concat(F.lit("unknown tier "), F.coalesce(t, F.lit("null")))).cast(_kind(name))
        )
    return out.otherwise(F.lit(default)) if default is not None else out


def _kind(name: str) -> str:
    if name.endswith(("_ms", "_s")):
        return "long"
    return "string" if isinstance(TIERS[DEFAULT_TIER][name], str) else "int"


def with_tier(df: DataFrame, topics: DataFrame, topic: str = "topic", tier: str = "tier") -> DataFrame:
    """Left lookup of a topic's tier; ``standard`` when the topic or its tier is missing.

    ``topics`` is reduced to one row per topic first, so a topic listed twice does not multiply rows.
    """
    known = topics.groupBy(topic).agg(F.max(tier).alias(tier))
    return df.drop(tier).join(known, topic, "left").withColumn(tier, tier_or_default(tier))


def with_thresholds(df: DataFrame, kind: str = "lag", tier: str = "tier") -> DataFrame:
    """Add ``warn`` and ``alert`` limits: ``lag`` in seconds or ``records`` in records."""
    suffix = "_s" if kind == "lag" else ""
    standard = TIERS[DEFAULT_TIER]
    return df.withColumns({
        "warn": tier_value(tier, f"{kind}_warn{suffix}", standard[f"{kind}_warn{suffix}"]).cast("long"),
        "alert": tier_value(tier, f"{kind}_alert{suffix}", standard[f"{kind}_alert{suffix}"]).cast("long"),
    })


def effective_settings(df: DataFrame, tier: str = "tier", retention_years: int = -1) -> DataFrame:
    """Tier settings with non-null ``*_override`` columns taking precedence."""
    years = -1 if checked_years(retention_years) == -1 else retention_years * 31557600000
    retention = F.when(F.col(tier) == "compliance", F.lit(years).cast("long")).otherwise(
        tier_value(tier, "retention_ms", FALLBACK_SETTINGS["retention_ms"])
    )
    defaults = {
        "retention_ms": retention,
        **{n: tier_value(tier, n, FALLBACK_SETTINGS[n])
           for n in ("compatibility", "partitions", "tasks_sink", "tasks_source")},
    }
    chosen = {}
    for name, default in defaults.items():
        override = f"{name}_override"
        chosen[name] = F.coalesce(F.col(override), default) if override in df.columns else default
    return df.withColumns(chosen)

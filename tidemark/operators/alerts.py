"""Alert rules over samples and audit events. Results are tables of alerts."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names, slice_of, trailing_sums
from tidemark.functions.tiers import TIERS, tier_or_default, with_thresholds
from tidemark.functions.units import micros
from tidemark.session import listed


@dataclass(frozen=True)
class Rule:
    """``value <op> limit`` on a metric (and tier), held for ``hold_s`` before it fires."""

    rule: str
    metric: str
    op: str
    limit: float
    hold_s: int
    severity: str
    tier: str | None = None
    ceiling: float | None = None


# Seconds a mirror-lag or consumer-lag condition must hold, by tier.
MIRROR_HOLD_S = {"critical": 60, "standard": 300, "best-effort": 900, "compliance": 60}
CONSUMER_HOLD_S = {"critical": 300, "standard": 300, "best-effort": 600, "compliance": 300}


def _tier_rules(metric: str, prefix: str, kind: str, holds: Mapping[str, int]) -> list[Rule]:
    suffix = "_s" if kind == "lag" else ""
    return [
        Rule(f"{prefix}-{tier}-{level}", metric, "gt", float(TIERS[tier][f"{kind}_{level}{suffix}"]), holds[tier], level, tier)
        for tier in TIERS
        for level in ("warn", "alert")
    ]


def mirror_lag_rules(metric: str = "mirror_lag_seconds") -> list[Rule]:
    return _tier_rules(metric, "mirror-lag", "lag", MIRROR_HOLD_S)


def consumer_lag_rules(metric: str = "consumer_lag_records") -> list[Rule]:
    return _tier_rules(metric, "consumer-lag", "records", CONSUMER_HOLD_S)


# Limits and hold times of the platform rules.
PLATFORM_RULES = (
    Rule("connector-failed", "failed_connectors", "gt", 0.0, 60, "alert"),
    Rule("restart-loop", "task_restarts_15m", "gt", 3.0, 60, "alert"),
    Rule("under-replicated", "under_replicated_partitions", "gt", 0.0, 300, "alert"),
    Rule("no-controller", "active_controllers", "lt", 1.0, 60, "alert"),
    Rule("pending-warn", "pending_records", "gt", 1000.0, 300, "warn"),
    Rule("pending-alert", "pending_records", "gt", 10000.0, 300, "alert"),
    Rule("throughput-drop", "records_out_rate_10m", "lt", 1.0, 600, "warn"),
    Rule("slot-retention", "slot_retained_bytes", "gt", 1073741824.0, 0, "alert"),
)


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table, for callers that keep theirs in one."""
    schema = "rule string, metric string, op string, limit double, hold_s long, severity string, tier string, ceiling double"
    rows = [asdict(r) for r in rules]
    return listed(spark, {f.name: [row[f.name] for row in rows] for f in fields(Rule)}, schema)


_COMPARE = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}


def with_rules(samples: DataFrame, rules: Sequence[Rule] | DataFrame, value: str = "value") -> DataFrame:
    """Samples with every rule of their metric (and tier): adds ``rule``, ``hold_s``, ``severity``, ``breached``.

    A list of rules becomes an expression on the sample. A table of rules is joined on the metric; it
    has a few rows per metric, and Spark broadcasts it if its size allows.
    """
    v = F.col(value)
    tier = tier_or_default("tier") if "tier" in samples.columns else None
    if isinstance(rules, DataFrame):
        r = rules.withColumnsRenamed({"metric": "_metric", "tier": "_tier"})
        on = F.col("metric") == F.col("_metric")
        if tier is not None:
            on &= F.col("_tier").isNull() | (F.col("_tier") == tier)
        over = F.lit(False)
        for op, compare in reversed(_COMPARE.items()):
            over = F.when(F.col("op") == op, compare(v, F.col("limit"))).otherwise(over)
        over &= F.col("ceiling").isNull() | (v <= F.col("ceiling"))
        joined = samples.join(r, on, "inner").withColumn("breached", F.coalesce(over, F.lit(False)))
        return joined.drop("_metric", "_tier", "op", "limit", "ceiling")

    def applied(rule: Rule) -> Column:
        mine = F.col("metric") == rule.metric
        if tier is not None and rule.tier is not None:
            mine &= tier == rule.tier
        over = _COMPARE[rule.op](v, F.lit(float(rule.limit)))
        if rule.ceiling is not None:
            over &= v <= F.lit(float(rule.ceiling))
        return F.when(mine, F.struct(
            F.lit(rule.rule).alias("rule"), F.lit(rule.hold_s).cast("long").alias("hold_s"),
            F.lit(rule.severity).alias("severity"), F.coalesce(over, F.lit(False)).alias("breached"),
        ))

    hits = F.array_compact(F.array(*[applied(rule) for rule in rules]))
    return samples.withColumn("_rule", F.explode(hits)).select(*samples.columns, "_rule.*")


def alert_sustained(
    samples: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    by: str | Sequence[str],
    time: str = "ts",
    value: str = "value",
    max_gap: str | int = "5 minutes",
    order: str | Sequence[str] = (),
    width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """One row per run of breaching samples that lasted at least the rule's hold time.

    A sample that does not breach, or a gap longer than ``max_gap``, ends a run.

    Samples collapse to runs inside each time slice, in the order they are sorted in: a run is the row of its last sample,
    and the quiet samples are the row of their first. A run may continue across slices only where it
    touches the first or last sample of one, so those runs and one row for the quiet samples (at most
    three rows per slice) are put in order per series; every other run is already complete and stays
    in a lane of its own.
    """
    by, order = names(by), names(order)
    key, gap = ["rule", *by], micros(max_gap)
    ruled = with_rules(samples, rules, value).select(
        *key, *order, F.unix_micros(time).alias("_us"), F.col(value).alias("_value"),
        "breached", "hold_s", "severity", slice_of(time, width).alias("_slice"),
    )
    inside = Window.partitionBy(*key, "_slice").orderBy("_us", *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    seen = ruled.withColumns({
        "_was": F.lag("breached").over(inside), "_at": F.lag("_us").over(inside), "_nth": F.row_number().over(inside),
        "_then": F.lead("_us").over(inside), "_will": F.lead("breached").over(inside),
    })
    starts = F.col("_at").isNull() | ~F.col("_was") | (F.col("_us") - F.col("_at") > gap)
    seen = seen.withColumn("_start", F.when(F.col("breached") & starts, F.struct("_us", "_nth", F.col("_at").isNull().alias("opens"))))
    # The number of a run grows along the slice, so the largest pair so far has the peak of the newest run.
    seen = seen.withColumns({"_run": F.last("_start", ignorenulls=True).over(upto), "_quiet": F.count_if(~F.col("breached")).over(upto)})
    seen = seen.withColumn("_top", F.max(F.when(F.col("breached"), F.struct("_run._nth", "_value"))).over(upto))
    ends = F.col("_then").isNull() | ~F.col("_will") | (F.col("_then") - F.col("_us") > gap)
    of_rule = ["hold_s", "severity"]
    run = F.struct(
        *of_rule, F.col("_run._us").alias("begun"), F.col("_run._nth").alias("nth"), F.col("_us").alias("end"),
        (F.col("_nth") - F.col("_run._nth") + 1).cast("long").alias("n"), F.col("_top._value").alias("peak"),
        F.col("_run.opens").alias("opens"), F.col("_then").isNull().alias("closes"))
    runs = seen.filter((F.col("breached") & ends) | (~F.col("breached") & (F.col("_quiet") == 1))).select(
        *key, "_slice", F.when(F.col("breached") & F.col("_us").isNotNull(), run).alias("_of"))

    of = lambda c: F.col(f"_of.{c}")
    firing = F.col("_of").isNotNull()
    lane = F.when(firing & ~of("opens") & ~of("closes"), F.xxhash64("_slice", of("nth")))
    # Within a slice: the run with its first sample, the quiet samples, the run with its last sample.
    place = F.when(firing & of("opens"), 0).when(~firing, 1).otherwise(2)
    edge = Window.partitionBy(*key, "_lane").orderBy("_slice", "_place")
    laned = runs.withColumns({"_lane": lane, "_place": place}).withColumn("_before", F.lag("_of").over(edge))
    goes_on = of("opens") & F.col("_before.closes") & (of("begun") - F.col("_before.end") <= gap)
    laned = laned.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    laned = laned.withColumn("_head", F.when(firing & ~F.col("_on"), F.struct(of("begun"), of("nth"))))
    laned = laned.withColumns({
        "_head": F.last("_head", ignorenulls=True).over(edge.rowsBetween(Window.unboundedPreceding, 0)),
        "_more": F.coalesce(F.lead("_on").over(edge), F.lit(False)),
    })
    # A run that neither goes on nor is gone on with is whole, and needs no aggregation to be found too short.
    short = of("end") - of("begun") < of("hold_s") * F.lit(1000000)
    held = laned.filter(firing & (F.col("_on") | F.col("_more") | ~short)).select(
        *key, *[of(c).alias(c) for c in of_rule], F.col("_head.begun").alias("_island"), F.col("_head.nth").alias("_nth"),
        of("end").alias("_end"), of("n").alias("_n"), of("peak").alias("_peak"))
    # Several runs of a slice may begin at one time.
    whole = held.groupBy(*key, *of_rule, "_island", "_nth").agg(
        F.max("_end").alias("_end"), F.sum("_n").alias("samples"), F.max("_peak").alias("peak"),
    )
    hold = F.col("hold_s") * F.lit(1000000)
    return whole.filter(F.col("_end") - F.col("_island") >= hold).select(
        *key, F.timestamp_micros("_island").alias("started"), F.timestamp_micros("_end").alias("last_seen"),
        "samples", "peak", "hold_s", "severity", F.timestamp_micros(F.col("_island") + hold).alias("fired_at"),
    )


def assess_lag(df: DataFrame, lag: str = "lag_s", tier: str = "tier") -> DataFrame:
    """Add ``warn``, ``alert`` and ``status``: at or above alert ALERT, at or above warn WARN, else OK."""
    return with_thresholds(df, "lag", tier).withColumn(
        "status",
        F.when(F.col(lag) >= F.col("alert"), "ALERT").when(F.col(lag) >= F.col("warn"), "WARN").otherwise("OK"),
    )


def warn_band(df: DataFrame, value: str, kind: str = "lag", tier: str = "tier") -> DataFrame:
    """Rows above the warn limit but not above the alert limit."""
    return with_thresholds(df, kind, tier).filter((F.col(value) > F.col("warn")) & (F.col(value) <= F.col("alert")))


def alert_avg(
    df: DataFrame, by: str | Sequence[str], time: str, value: str, lookback: str | int, limit: float, width=DEFAULT_SLICE
) -> DataFrame:
    """Samples at which the average over the look-back exceeds the limit (value is an exact type)."""
    out = trailing_sums(df.withColumn("_one", F.lit(1)), by, time, lookback, {"_sum": value, "_n": "_one"}, width)
    out = out.withColumn("window_avg", F.col("_sum").cast("double") / F.col("_n").cast("double"))
    return out.filter(F.col("window_avg") > limit).drop("_sum", "_n", "_one")


def bursts(
    events: DataFrame, by: str | Sequence[str], time: str, lookback: str | int, at_least: int, width=DEFAULT_SLICE
) -> DataFrame:
    """Events at which the group's count over the look-back reaches ``at_least``."""
    out = trailing_sums(events.withColumn("_one", F.lit(1).cast("long")), by, time, lookback, {"in_window": "_one"}, width)
    return out.filter(F.col("in_window") >= at_least).drop("_one")


def auth_bursts(
    audit: DataFrame, limit: int = 10, lookback: str | int = "60 seconds", principal: str = "principal",
    time: str = "ts", failed: Column | None = None, width=DEFAULT_SLICE,
) -> DataFrame:
    """Authentication failures at which a principal has more than ``limit`` in the look-back."""
    chosen = failed if failed is not None else (F.col("event") == "authentication") & (F.col("result") == "FAILURE")
    return bursts(audit.filter(chosen), principal, time, lookback, limit + 1, width)


def denied_on(audit: DataFrame, topic: str, result: str = "result", resource: str = "resource") -> DataFrame:
    """Denied accesses to one topic."""
    return audit.filter((F.col(result) == "DENIED") & (F.col(resource) == topic))


def unauthorised_deletes(
    audit: DataFrame, admins: DataFrame, principal: str = "principal", deleted: Column | None = None
) -> DataFrame:
    """Schema hard deletes by principals that are not schema administrators."""
    hard = deleted if deleted is not None else F.col("event") == "schema.hard_delete"
    return audit.filter(hard).join(admins.select(principal).distinct(), principal, "left_anti")


def outside_windows(
    events: DataFrame, windows: DataFrame, time: str = "ts", start: str = "start", end: str = "end", width: str | int = "1 hour",
) -> DataFrame:
    """Events inside no maintenance window (``start <= t < end``); windows may overlap.

    Windows are cut into slices of ``width`` and merged inside each to disjoint intervals; an event meets those of its
    own slice, and a slice with many events is a skewed join that Spark splits. A window is a row for each slice it touches. An event
    without a time is outside; a window without a start or an end covers nothing.
    """
    step = micros(width)
    head = lambda us: us - F.pmod(us, F.lit(step))
    spans = windows.select(F.unix_micros(start).alias("_start"), F.unix_micros(end).alias("_end")).filter("_start < _end")
    spans = spans.withColumn("_at", F.explode(F.sequence(head(F.col("_start")), head(F.col("_end") - 1), F.lit(step))))
    spans = spans.select("_at", F.greatest("_start", "_at").alias("_start"), F.least(F.col("_end"), F.col("_at") + step).alias("_end"))
    spans = spans.groupBy("_at", "_start").agg(F.max("_end").alias("_end"))
    order = Window.partitionBy("_at").orderBy("_start")
    reached = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(reached < F.col("_start"), F.lit(True)).cast("int"))
    spans = spans.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_at", "_run").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
    placed = events.withColumn("_us", F.unix_micros(time)).withColumn("_slice", head(F.col("_us")))
    inside = (F.col("_slice") == F.col("_at")) & (F.col("_us") >= F.col("_start")) & (F.col("_us") < F.col("_end"))
    return placed.join(spans, inside, "left_anti").drop("_us", "_slice")


def confidential_access(
    audit: DataFrame, topics: DataFrame, lookback: str | int = "5 minutes", at_least: int = 1, topic: str = "topic",
    time: str = "ts", denied: Column | None = None, width=DEFAULT_SLICE,
) -> DataFrame:
    """Denied reads of confidential topics, where a topic has at least ``at_least`` in the look-back."""
    refused = denied if denied is not None else (F.col("result") == "DENIED") & (F.col("operation") == "Read")
    secret = topics.filter(F.col("classification") == "confidential").select(topic).distinct()
    return bursts(audit.filter(refused).join(secret, topic, "left_semi"), topic, time, lookback, at_least, width)


def decryption_failures(
    failures: DataFrame, by: str | Sequence[str], limit: int = 5, lookback: str | int = "10 minutes", time: str = "ts",
    width=DEFAULT_SLICE,
) -> DataFrame:
    """Failures at which their number in the look-back exceeds the limit."""
    return bursts(failures, by, time, lookback, limit + 1, width)

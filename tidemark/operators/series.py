"""Metric series: counter rates, reductions, aggregates by label, quantiles.

A series table is long form: label columns, a time column and a value column. Functions that read
counters use exact (integer or decimal) values.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names, slice_of, swept_in_halo, with_halo
from tidemark.functions.units import instant, micros
from tidemark.session import durable

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}


def counter_window(
    df: DataFrame, by: str | Sequence[str], lookback: str | int, time: str = "ts", value: str = "value",
    width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """Per sample: ``increase`` and ``elapsed_us`` between the first and last sample in ``(t - w, t]``.

    A value below its predecessor is a counter reset and counts from zero. Both columns are sums over
    neighbouring sample pairs, so each pair enters the running sum with its later sample and leaves
    when its earlier sample leaves the look-back: the work is linear in the samples. With fewer than
    two samples both are null. Every sample gives one row, also where a time repeats; which of such samples is the
    earlier one is not defined. A row without a time is no sample.

    One shuffle by (key, slice), whatever the look-back: slices are at least as wide, so a sample is copied to one
    more slice at most. A hot series is spread over its slices; no task holds more of it than two look-backs.
    """
    by, back, df = names(by), micros(lookback), df.filter(F.col(time).isNotNull())
    us = F.unix_micros(time)
    inside = Window.partitionBy(*by, "_slice").orderBy(us)
    rows = with_halo(df, time, back, width).withColumns({"_before": F.lag(F.col(value)).over(inside), "_before_us": F.lag(us).over(inside)})
    paired = F.col("_before_us").isNotNull() & (F.col("_before_us") + F.lit(back) > us)
    step = F.when(F.col(value) >= F.col("_before"), F.col(value) - F.col("_before")).otherwise(F.col(value))
    zero = F.lit(0).cast(df.schema[value].dataType)
    rows = rows.withColumns({
        "_step": F.when(paired, step).otherwise(zero),
        "_gap": F.when(paired, us - F.col("_before_us")).otherwise(F.lit(0).cast("long")),
        "_leave": F.when(paired, F.col("_before_us") + F.lit(back)).otherwise(us + F.lit(1)),
    }).drop("_before", "_before_us")
    out = swept_in_halo(rows, by, us, F.col("_leave"), {"increase": "_step", "elapsed_us": "_gap"})
    enough = F.col("elapsed_us") > 0
    return out.withColumns({
        "increase": F.when(enough, F.col("increase")), "elapsed_us": F.when(enough, F.col("elapsed_us")),
    }).drop("_step", "_gap", "_leave")


def increase(df: DataFrame, by, lookback, time: str = "ts", value: str = "value", width=DEFAULT_SLICE) -> DataFrame:
    """Counter increase over the look-back, per sample."""
    return counter_window(df, by, lookback, time, value, width).drop("elapsed_us")


def rate(df: DataFrame, by, lookback, time: str = "ts", value: str = "value", width=DEFAULT_SLICE) -> DataFrame:
    """Counter rate per second over the look-back: increase over time between first and last sample."""
    out = counter_window(df, by, lookback, time, value, width)
    per_second = F.col("increase").cast("double") / (F.col("elapsed_us").cast("double") / F.lit(1e6))
    return out.withColumn("rate", per_second).drop("increase", "elapsed_us")


def agg_series(df: DataFrame, fn: str, by: str | Sequence[str] = (), value: str = "value", out: str | None = None):
    """``sum``, ``max``, ``min``, ``avg`` or ``count`` of a value over all series or by label."""
    return df.groupBy(*names(by)).agg(_AGGREGATES[fn](value).alias(out or f"{fn}_{value}"))


def count_series(df: DataFrame, where: Column | None = None, by: str | Sequence[str] = (), out: str = "n") -> DataFrame:
    """Number of samples that satisfy a predicate."""
    return df.groupBy(*names(by)).agg((F.count_if(where) if where is not None else F.count("*")).alias(out))


def count_distinct(
    df: DataFrame, column: str, where: Column | None = None, by: str | Sequence[str] = (), out: str = "n",
    approximate: bool = False,
) -> DataFrame:
    """Distinct values of a column, plain or among rows that satisfy a predicate."""
    chosen = F.when(where, F.col(column)) if where is not None else F.col(column)
    return df.groupBy(*names(by)).agg((F.approx_count_distinct if approximate else F.countDistinct)(chosen).alias(out))


def latest(
    df: DataFrame, by: str | Sequence[str], time: str, cols: Sequence[str], order: str | Sequence[str] = ()
) -> DataFrame:
    """Fields of the newest sample of each group."""
    order = names(order)
    position = F.struct(time, *order) if order else F.col(time)
    newest = df.groupBy(*names(by)).agg(F.max_by(F.struct(*cols), position).alias("_last"))
    return newest.select(*names(by), "_last.*")


def reduce_last(
    df: DataFrame, by, now: datetime | Column, lookback, fn: str = "last", time: str = "ts", value: str = "value"
) -> DataFrame:
    """One value per series from the samples in ``(now - lookback, now]``: the last or the largest."""
    at = instant(now)
    kind = df.schema[time].dataType
    start = F.timestamp_micros(F.unix_micros(at) - F.lit(micros(lookback)))
    recent = df.filter((F.col(time) > start.cast(kind)) & (F.col(time) <= at.cast(kind)))
    agg = F.max_by(value, time) if fn == "last" else _AGGREGATES[fn](value)
    return recent.groupBy(*names(by)).agg(agg.alias(value))


def percentile(
    df: DataFrame, q: float, by: str | Sequence[str], value: str = "value", out: str = "p", bins: int = 4096
) -> DataFrame:
    """Exact percentile by group, interpolated between the two nearest values; null values are left out.

    The range of a group's values is cut into ``bins`` and counted, the bin of the wanted rank is the next range, until
    a range is one value. Every round is one aggregation that combines before the shuffle, and no task holds more than
    the bins of a group, however large the group is. A range's ends are bins of their own, so every round gets on.
    """
    by = names(by) or ["_all"]
    rows = df if "_all" not in by else df.withColumn("_all", F.lit(0))
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    rank = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    state = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # A written table has a known size: a small one goes to the rows, which then are not shuffled.
    state = durable(state.select(*by, rank.alias("_rank"), F.floor(rank).alias("_target"), "_low", "_high"), "ranges")

    def to_rows(groups: DataFrame) -> DataFrame:
        same = [F.col(f"_g{i}").eqNullSafe(rows[c]) for i, c in enumerate(by)]
        named = groups.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
        return rows.join(named, reduce(and_, same)).drop(*[f"_g{i}" for i in range(len(by))])

    while state.filter("_low < _high").limit(1).count():
        inside = to_rows(state.filter("_low < _high")).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        part = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.lit(float(bins))
        place = F.when(F.col("_v") == F.col("_low"), -1).when(F.col("_v") == F.col("_high"), bins)
        place = place.otherwise(F.when(F.isnan(part), 0).otherwise(F.least(F.floor(part), F.lit(bins - 1))).cast("int"))
        counts = inside.groupBy(*by, "_rank", "_target", place.alias("_bin")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        ordered = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_end", F.sum("_c").over(ordered))
        chosen = counts.filter((F.col("_end") > F.col("_target")) & (F.col("_end") - F.col("_c") <= F.col("_target")))
        chosen = chosen.withColumn("_target", F.col("_target") - (F.col("_end") - F.col("_c"))).select(*state.columns)
        state = durable(state.filter("_low = _high").union(chosen), "ranges")

    above = F.col("_v") > F.col("_low")
    ends = to_rows(state.select(*by, "_rank", "_low")).groupBy(*by, "_rank", "_low").agg(
        F.count(F.when(~above, 1)).alias("_upto"), F.min(F.when(above, F.col("_v"))).alias("_next"))
    upper = F.when(F.ceil("_rank") < F.col("_upto"), F.col("_low")).otherwise(F.col("_next"))
    between = F.col("_rank") - F.floor("_rank")
    answer = F.when(between == 0, F.col("_low")).otherwise(F.col("_low") + (upper - F.col("_low")) * between)
    return ends.select(*[c for c in by if c != "_all"], answer.alias(out))


def approx_percentile(df: DataFrame, q: float, by: str | Sequence[str], value: str = "value", out: str = "p",
                      accuracy: int = 10000) -> DataFrame:
    """Approximate percentile by group, in one pass."""
    return df.groupBy(*names(by)).agg(F.percentile_approx(value, q, accuracy).alias(out))


def histogram_quantile(
    df: DataFrame, q: float, by: str | Sequence[str] = (), le: str = "le", value: str = "value", out: str = "quantile"
) -> DataFrame:
    """Quantile from cumulative buckets, linear within the bucket that holds the rank.

    Buckets are summed by (labels, ``le``) first, so the ordered scan sees one row per bucket bound.
    ``le`` is a double with +Infinity for the last bucket; a rank in it gives the highest finite bound.
    A label set without an infinite bucket or without observations gives null.
    """
    by = names(by)
    buckets = df.groupBy(*by, le).agg(F.sum(F.col(value).cast("double")).alias("_c"))
    if not by:
        buckets = buckets.withColumn("_all", F.lit(0))
    part = by or ["_all"]
    ordered = Window.partitionBy(*part).orderBy(le)
    total = F.last("_c").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = F.last(le).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inf = F.lit(float("inf"))
    found = buckets.withColumns({
        "_rank": F.lit(q) * total, "_top": top, "_total": total,
        "_low": F.lag(le).over(ordered), "_below": F.coalesce(F.lag("_c").over(ordered), F.lit(0.0)),
    })
    low = F.coalesce(F.col("_low"), F.when(F.col(le) > 0, F.lit(0.0)).otherwise(F.col(le)))
    within = (F.col("_rank") - F.col("_below")) / (F.col("_c") - F.col("_below"))
    point = F.when(F.col(le) == inf, F.col("_low")).when(
        F.col("_c") > F.col("_below"), low + (F.col(le) - low) * within
    ).otherwise(low)
    usable = (F.col("_top") == inf) & (F.col("_total") > 0)
    answer = F.min_by(F.when(usable, point), F.when(F.col("_c") >= F.col("_rank"), F.col(le)))
    result = found.groupBy(*part).agg(answer.alias(out))
    return result if by else result.drop("_all")


def or_zero(df: DataFrame, column: str) -> DataFrame:
    """The single value of a global aggregate, or one row with 0 when there is none."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias(column))


def ratio(part: DataFrame, whole: DataFrame, on: str | Sequence[str], a: str, b: str, out: str = "percent"):
    """``part / whole * 100`` for label sets present on both sides; null when the whole is zero."""
    both = part.select(*names(on), a).join(whole.select(*names(on), b), names(on), "inner")
    return both.withColumn(out, F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) * F.lit(100.0))


def add_series(a: DataFrame, b: DataFrame, on: str | Sequence[str], value: str = "value") -> DataFrame:
    """Sum of two series sets at the labels and times both have."""
    right = b.select(*names(on), F.col(value).alias("_other"))
    both = a.select(*names(on), value).join(right, names(on), "inner")
    return both.withColumn(value, F.col(value) + F.col("_other")).drop("_other")


def lag_seconds(lag: DataFrame, received_rate: DataFrame, on: str | Sequence[str], value="value", rate_col="rate"):
    """Offset lag over received records per second; null while nothing is received."""
    both = lag.select(*names(on), value).join(received_rate.select(*names(on), rate_col), names(on), "inner")
    return both.withColumn("lag_seconds", F.try_divide(F.col(value).cast("double"), F.col(rate_col)))


def progress_lag(df: DataFrame, now: datetime | Column, checkpoint_ns: str = "value") -> DataFrame:
    """Seconds between ``now`` and a checkpoint in epoch nanoseconds."""
    return df.withColumn("progress_lag_s", F.unix_micros(instant(now)) / F.lit(1e6) - F.col(checkpoint_ns) / F.lit(1e9))


def throughput(records_in: DataFrame, records_out: DataFrame, on: str | Sequence[str], rate_col: str = "rate"):
    """Rates in and out side by side for the same labels."""
    a = records_in.select(*names(on), F.col(rate_col).alias("in_per_s"))
    return a.join(records_out.select(*names(on), F.col(rate_col).alias("out_per_s")), names(on), "full")


def state_history(
    df: DataFrame, key: str | Sequence[str], time: str, state: str, order: str | Sequence[str] = (), width=DEFAULT_SLICE
) -> DataFrame:
    """State changes with the time the next change ends them; repeated samples of a state collapse.

    Samples collapse to runs inside each time slice. A slice's first and last run may continue in its
    neighbours, so these (at most two per slice) are looked at together per key; every other run is
    already complete and stays in a lane of its own.
    """
    key, order = names(key), names(order)
    sliced = df.select(*key, time, state, *order).withColumn("_slice", slice_of(time, width))
    inside = Window.partitionBy(*key, "_slice").orderBy(F.unix_micros(time), *order)
    marked = sliced.withColumns({"_first": F.row_number().over(inside) == 1, "_was": F.lag(state).over(inside)})
    runs = marked.filter(F.col("_first") | ~F.col("_was").eqNullSafe(F.col(state)))
    runs = runs.withColumn("_next", F.lead(time).over(inside))

    lane = F.when(~F.col("_first") & F.col("_next").isNotNull(), F.xxhash64("_slice", F.unix_micros(time), *order))
    edge = Window.partitionBy(*key, "_lane").orderBy("_slice", F.unix_micros(time), *order)
    laned = runs.withColumn("_lane", lane).withColumns({
        "_before": F.lag(F.struct(F.col(state).alias("s"))).over(edge),
        "_inner": F.col("_lane").isNotNull(),
    })
    same = F.col("_first") & F.col("_before").isNotNull() & F.col("_before.s").eqNullSafe(F.col(state))
    laned = laned.withColumn("_change", ~same)
    point = F.when(F.col("_change"), F.col(time)).otherwise(F.col("_next"))
    back = Window.partitionBy(*key, "_lane").orderBy(*[F.desc(c) for c in ("_slice", F.unix_micros(time), *order)])
    later = F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    laned = laned.withColumn("until", F.coalesce("_next", F.when(~F.col("_inner"), later)))
    return laned.filter("_change").select(*key, F.col(time).alias("since"), "until", state)


def top_lag(df: DataFrame, by: str | Sequence[str], time: str, value: str, k: int = 100, order=()) -> DataFrame:
    """The ``k`` largest latest values; ties are broken by the labels."""
    newest = latest(df, by, time, [value], order)
    return newest.orderBy(F.desc(value), *names(by)).limit(k)


def top_series(df: DataFrame, by: str | Sequence[str], k: int, time: str = "ts", value: str = "value", order=()):
    """The ``k`` series with the largest last value."""
    return top_lag(df, by, time, value, k, order)

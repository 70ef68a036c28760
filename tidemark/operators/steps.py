"""Series at evaluation steps: what a look-back holds at each point of a grid of times.

A sample is the newest of a look-back at the grid points from its own time to the next sample's, and the oldest from
when the sample before it leaves to when it leaves itself. Each sample thus marks two ranges of grid points, and between
two marks of a series the same two samples stand at the ends; the increase is the difference of their running totals.
The work is linear in the samples and the points; no look-back is rescanned, and points unfold last, in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names, with_halo
from tidemark.functions.units import micros, whole_div


def _up(us: Column, step: int) -> Column:
    """Number of the first grid point at or after a time."""
    return -whole_div(-us, step)


def at_steps(
    df: DataFrame, by: str | Sequence[str], step: str | int, lookback: str | int | Mapping[str, str | int], time: str = "ts",
    value: str = "value", stale: str | int | None = None, width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """(by, at, samples, last, increase, elapsed_us, rate) at every multiple of ``step`` that has a sample in ``(at - lookback, at]``.

    ``last`` is the newest value, null if it is as old as ``stale`` or older. ``increase`` is the counter's between the first
    and last sample, resets counted from zero, ``rate`` that per second; both are null with fewer than two times. Values are
    of an exact type; a sample without a time or a value is none. Of samples with one time any may be the first or last.

    Several look-backs by name, as a mapping, add a column ``window`` and are read from the same scan. One shuffle by
    (key, slice); slices are as wide as the longest look-back, so a sample is copied to one more slice at most.
    """
    by, step = names(by), micros(step)
    backs = {k: micros(v) for k, v in lookback.items()} if isinstance(lookback, Mapping) else {"": micros(lookback)}
    longest = max(backs.values())
    wide = max(micros(width), longest)
    samples = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(time).alias("_at"), F.col(value).alias("_v"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_us")
    rows = with_halo(samples, "_at", longest, width).withColumn("_us", F.unix_micros("_at")).drop("_at").withColumns({
        "_place": F.row_number().over(inside), "_was": F.lag("_v").over(inside),
        "_before": F.lag("_us").over(inside), "_after": F.lead("_us").over(inside),
    })
    grown = F.when(F.col("_v") >= F.col("_was"), F.col("_v") - F.col("_was")).when(F.col("_was").isNotNull(), F.col("_v"))
    zero = F.lit(0).cast(df.schema[value].dataType)
    rows = rows.withColumn("_grown", F.coalesce(grown, zero))
    rows = rows.withColumn("_total", F.sum("_grown").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    t, begin, end = F.col("_us"), F.col("_slice") * F.lit(wide), (F.col("_slice") + 1) * F.lit(wide)

    def marks(window: int, back: int) -> list[Column]:
        gone = t + F.lit(back)
        newest = F.greatest(t, begin), F.least(F.coalesce(F.col("_after"), end), gone, end)
        oldest = F.greatest(t, F.coalesce(F.col("_before") + F.lit(back), begin), begin), F.least(gone, end)
        return [F.struct(F.lit(window).alias("_w"), _up(low, step).alias("_k"), _up(high, step).alias("_until"), F.lit(new).alias("_new"))
                for (low, high), new in ((newest, True), (oldest, False))]

    every = F.filter(F.array(*[m for i, back in enumerate(backs.values()) for m in marks(i, back)]), lambda m: m["_k"] < m["_until"])
    ends = rows.withColumn("_m", F.explode(every)).select(*by, "_slice", "_m.*", F.struct("_us", "_place", "_total", "_v", "_m._until").alias("_held"))
    along = Window.partitionBy(*by, "_slice", "_w").orderBy("_k")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    found = ends.select(*by, "_w", "_k", F.lead("_k").over(along).alias("_next"), *[
        F.last(F.when(F.col("_new") == new, F.col("_held")), ignorenulls=True).over(so_far).alias(n) for n, new in (("_b", True), ("_a", False))])
    upto = F.least("_next", "_b._until", "_a._until")
    found = found.filter((F.col("_k") < upto) & F.col("_a").isNotNull() & F.col("_b").isNotNull()).withColumn("_k", F.explode(F.sequence("_k", upto - 1)))
    at = F.col("_k") * F.lit(step)
    elapsed = F.col("_b._us") - F.col("_a._us")
    increase = F.col("_b._total") - F.col("_a._total")
    fresh = at - F.col("_b._us") < F.lit(micros(stale) if stale is not None else longest)
    return found.select(
        *by, *([F.element_at(F.array(*map(F.lit, backs)), F.col("_w") + 1).alias("window")] if isinstance(lookback, Mapping) else []), F.timestamp_micros(at).alias("at"),
        (F.col("_b._place") - F.col("_a._place") + 1).cast("long").alias("samples"), F.when(fresh, F.col("_b._v")).alias("last"),
        F.when(elapsed > 0, increase).alias("increase"), F.when(elapsed > 0, elapsed).alias("elapsed_us"),
        F.when(elapsed > 0, increase.cast("double") / (elapsed.cast("double") / F.lit(1e6))).alias("rate"))

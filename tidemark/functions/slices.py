"""Ordered per-key computations that do not put a whole key into one task.

A window over ``partitionBy(key)`` sends every row of a hot key to one task. The functions here
partition by (key, slice) instead, where a slice is a fixed-width range of the ordering column. Each
slice is reduced to one summary row, the summaries are scanned per key in slice order, and what a slice
needs from the others is added to it as an edge row. A hot key is thus spread over as many tasks as it
has slices, and only the summaries (one row per key and slice) meet in one place.

The ordering column is a timestamp, or an integer such as a version number; ``width`` is an interval
or a number accordingly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.units import micros, whole_div

DEFAULT_SLICE = "15 minutes"

_FRAME_START = Window.unboundedPreceding
_MERGEABLE = {"sum": F.sum, "min": F.min, "max": F.max, "bit_or": F.bit_or, "bit_and": F.bit_and}


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def slice_of(time: Column | str, width: str | int = DEFAULT_SLICE) -> Column:
    """Number of the fixed-width slice a timestamp falls into."""
    t = F.col(time) if isinstance(time, str) else time
    return whole_div(F.unix_micros(t), micros(width))


def _ticks(df: DataFrame, column: str) -> Column:
    integral = isinstance(df.schema[column].dataType, T.IntegralType)
    return F.col(column).cast("long") if integral else F.unix_micros(column)


def scan(
    df: DataFrame,
    key: str | Sequence[str],
    time: str,
    order: str | Sequence[str] = (),
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    running: Mapping[str, tuple[str, str]] | None = None,
    before: Mapping[str, tuple[str, str]] | None = None,
    width: str | int | None = DEFAULT_SLICE,
    peers: bool = False,
) -> DataFrame:
    """Add columns computed along each key in (time, order) order.

    ``previous`` and ``following`` map new columns to source columns of the neighbouring rows.
    ``running`` maps new columns to (function, source column) over the rows up to and including each
    row, ``before`` over the rows before it. Functions: sum, min, max, bit_or, bit_and, and last (the
    last non-null value). Use exact types for sums. With ``peers``, ``running`` also takes in the rows
    that are equal in (time, order).

    The input is read twice: once for the summaries, with only the columns they need, and once for
    the rows. Make an expensive input ``durable`` first. A ``width`` of None keeps each key whole, for keys known to be
    small: one read, and one shuffle at most.
    """
    key, order = names(key), names(order)
    previous, following = dict(previous or {}), dict(following or {})
    folds = {**(running or {}), **(before or {})}
    if width is None:
        along = Window.partitionBy(*key).orderBy(time, *order)
        upto = along.rangeBetween(_FRAME_START, 0) if peers else along.rowsBetween(_FRAME_START, 0)
        return df.withColumns({
            **{n: F.lag(c).over(along) for n, c in previous.items()}, **{n: F.lead(c).over(along) for n, c in following.items()},
            **{n: _folded(fn, c).over(upto if n in (running or {}) else along.rowsBetween(_FRAME_START, -1)) for n, (fn, c) in folds.items()},
        })
    keys = [f"_k{i}" for i in range(len(key))]
    held = {n: f"_r{i}" for i, n in enumerate(folds)}
    ticks = _ticks(df, time)
    at = ["_t", *[f"_o{i}" for i in range(len(order))]]
    position = F.struct(*at) if order else F.col("_t")

    def read(column: str) -> Column:
        return F.col(f"_k{key.index(column)}" if column in key else f"_row.{column}")

    rows = df.select(
        *[F.col(k).alias(a) for k, a in zip(key, keys)],
        whole_div(ticks, micros(width)).alias("_slice"),
        ticks.alias("_t"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.struct(*[c for c in df.columns if c not in key], F.lit(0).alias("_")).alias("_row"),
    ).withColumns({
        "_edge": F.lit(0),
        **({"_back": F.struct(*[read(s).alias(n) for n, s in previous.items()])} if previous else {}),
        **({"_fwd": F.struct(*[read(s).alias(n) for n, s in following.items()])} if following else {}),
        **{held[n]: read(s) for n, (_, s) in folds.items()},
    })

    summary = rows.groupBy(*keys, "_slice").agg(
        *[F.max_by(F.col(f"_back.{n}"), position).alias(f"_b{i}") for i, n in enumerate(previous)],
        *[F.min_by(F.col(f"_fwd.{n}"), position).alias(f"_f{i}") for i, n in enumerate(following)],
        *[_reduced(fn, held[n], position).alias(held[n]) for n, (fn, _) in folds.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    so_far = across.rowsBetween(_FRAME_START, -1)
    edges = []
    if previous or folds:
        back = F.struct(*[F.col(f"_b{i}").alias(n) for i, n in enumerate(previous)]) if previous else None
        edges.append(summary.select(
            *keys, "_slice", F.lit(-1).alias("_edge"), F.lag("_slice").over(across).alias("_from"),
            *([F.lag(back).over(across).alias("_back")] if previous else []),
            *[_folded(fn, held[n]).over(so_far).alias(held[n]) for n, (fn, _) in folds.items()],
        ).filter(F.col("_from").isNotNull()).drop("_from"))
    if following:
        fwd = F.struct(*[F.col(f"_f{i}").alias(n) for i, n in enumerate(following)])
        edges.append(summary.select(
            *keys, "_slice", F.lit(1).alias("_edge"), F.lead("_slice").over(across).alias("_to"),
            F.lead(fwd).over(across).alias("_fwd"),
        ).filter(F.col("_to").isNotNull()).drop("_to"))
    every = rows
    for edge in edges:
        every = every.unionByName(edge, allowMissingColumns=True)

    within = Window.partitionBy(*keys, "_slice").orderBy("_edge", *at)
    upto = within.rangeBetween(_FRAME_START, 0) if peers else within.rowsBetween(_FRAME_START, 0)
    earlier = within.rowsBetween(_FRAME_START, -1)
    every = every.withColumns({
        **({"_p": F.lag("_back").over(within)} if previous else {}),
        **({"_n": F.lead("_fwd").over(within)} if following else {}),
        **{f"{held[n]}_": _folded(fn, held[n]).over(upto if n in (running or {}) else earlier) for n, (fn, _) in folds.items()},
    })
    # Keys come back as aliases of the partitioning columns, so Spark still knows the partitioning.
    return every.filter(F.col("_edge") == 0).select(
        *[F.col(f"_k{key.index(c)}").alias(c) if c in key else F.col(f"_row.{c}") for c in df.columns],
        *[F.col(f"_p.{n}") for n in previous], *[F.col(f"_n.{n}") for n in following],
        *[F.col(f"{held[n]}_").alias(n) for n in folds],
    )


def _reduced(fn: str, column: str, position: Column) -> Column:
    """One value for a whole slice."""
    if fn == "last":
        return F.max_by(column, F.when(F.col(column).isNotNull(), position))
    return _MERGEABLE[fn](column)


def _folded(fn: str, column: str) -> Column:
    """The same over rows or slices that are already in order."""
    return F.last(column, ignorenulls=True) if fn == "last" else _MERGEABLE[fn](column)


def with_neighbours(df, key, time, order=(), previous=None, following=None, width=DEFAULT_SLICE) -> DataFrame:
    """Values of the previous and the following row of the same key."""
    return scan(df, key, time, order, previous, following, width=width)


def carry_forward(df, key, time, value: str, out: str, order=(), width=DEFAULT_SLICE) -> DataFrame:
    """Last non-null ``value`` of the key at or before each row."""
    return scan(df, key, time, order, running={out: ("last", value)}, width=width)


def running_total(df, key, time, totals: Mapping[str, str], order=(), width=DEFAULT_SLICE) -> DataFrame:
    """Running sums per key."""
    return scan(df, key, time, order, running={n: ("sum", c) for n, c in totals.items()}, width=width)


def with_halo(df: DataFrame, time: str, lookback: str | int, width: str | int = DEFAULT_SLICE) -> DataFrame:
    """Copy each row to every slice whose rows can look back on it.

    Adds ``_slice`` and ``_home`` (true on the row's own slice). Slices are at least as wide as the
    look-back, so a row is copied at most once.
    """
    back = micros(lookback)
    wide = max(micros(width), back)
    us = F.unix_micros(time)
    own, last = whole_div(us, wide), whole_div(us + F.lit(back - 1), wide)
    return (
        df.withColumn("_own", own)
        .withColumn("_slice", F.explode(F.sequence(F.col("_own"), last)))
        .withColumn("_home", F.col("_slice") == F.col("_own"))
        .drop("_own")
    )


def trailing_sums(
    df: DataFrame,
    key: str | Sequence[str],
    time: str,
    lookback: str | int,
    sums: Mapping[str, str],
    width: str | int = DEFAULT_SLICE,
) -> DataFrame:
    """Sums of exact columns over the rows of the key in ``(t - lookback, t]``, for every row.

    Each row enters the running sum at its time and leaves it one look-back later, so the cost is
    linear in the rows however many of them a look-back holds. A look-back of at most one slice takes
    one shuffle; a longer one keeps its slices narrow and carries the sums across them. Rows without a
    time lie in no look-back and are left out.
    """
    key, back, df = names(key), micros(lookback), df.filter(F.col(time).isNotNull())
    enter, leave = F.unix_micros(time), F.unix_micros(time) + F.lit(back)
    if back <= micros(width):
        return swept_in_halo(with_halo(df, time, lookback, width), key, enter, leave, sums)
    return swept_across(df, key, enter, leave, sums, width)


def swept_in_halo(rows: DataFrame, key: list[str], enter: Column, leave: Column, sums: Mapping[str, str]) -> DataFrame:
    """Running sums over enter and leave marks inside each (key, slice) of haloed rows."""
    original = [c for c in rows.columns if c not in ("_slice", "_home")]
    marks = rows.withColumn(
        "_mark",
        F.explode(F.array(
            F.struct(enter.alias("at"), F.lit(1).alias("sign")),
            F.struct(leave.alias("at"), F.lit(-1).alias("sign")),
        )),
    )
    w = Window.partitionBy(*key, "_slice").orderBy("_mark.at", "_mark.sign").rangeBetween(_FRAME_START, 0)
    marks = marks.withColumns({n: F.sum(F.col(s) * F.col("_mark.sign")).over(w) for n, s in sums.items()})
    return marks.filter(F.col("_home") & (F.col("_mark.sign") == 1)).select(*original, *sums)


def swept_across(
    df: DataFrame, key: list[str], enter: Column, leave: Column, sums: Mapping[str, str], width: str | int
) -> DataFrame:
    """The same over narrow slices. Leave marks carry only their key, time and amounts."""
    rest = F.struct(*df.columns)
    marks = df.select(
        *[F.col(k).alias(f"_m{i}") for i, k in enumerate(key)],
        *[F.col(s).alias(f"_a{i}") for i, s in enumerate(sums.values())],
        F.explode(F.array(
            F.struct(enter.alias("at"), F.lit(1).alias("sign"), rest.alias("row")),
            F.struct(leave.alias("at"), F.lit(-1).alias("sign"), F.lit(None).cast(df.schema).alias("row")),
        )).alias("_mark"),
    )
    marks = marks.select(
        *[f"_m{i}" for i in range(len(key))], F.col("_mark.at").alias("_at"), F.col("_mark.sign").alias("_sign"),
        F.when(F.col("_mark.sign") == 1, F.col("_mark.row")).alias("_whole"),
        *[(F.col(f"_a{i}") * F.col("_mark.sign")).alias(f"_a{i}") for i in range(len(sums))],
    )
    out = scan(
        marks, [f"_m{i}" for i in range(len(key))], "_at", "_sign",
        running={n: ("sum", f"_a{i}") for i, n in enumerate(sums)}, width=width, peers=True,
    )
    return out.filter(F.col("_sign") == 1).select("_whole.*", *sums)

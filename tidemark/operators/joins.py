"""Point-in-time and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names, slice_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str] | None = None,
    how: str = "inner",
    order: str | Sequence[str] = (),
    width: str | int = DEFAULT_SLICE,
    salts: int = 1,
) -> DataFrame:
    """Each left row with the right version of its key valid at the left row's time.

    A version holds from its own time on (``right_time <= left_time``); of versions with equal time
    the last by ``order`` wins. Null keys never match. ``how`` is ``inner`` or ``left``.

    Both sides are partitioned by (key, time slice). The last version of each slice is scanned per
    key over the slices, and every slice that holds left rows gets the version it starts with as one
    extra row, so no task sees a whole key. Where one key and slice is still too much, ``salts``
    divides its left rows by hash and copies its versions to each part.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    on, order = names(on), names(order)
    take = list(take) if take is not None else [c for c in right.columns if c not in (*on, right_time)]
    clash = set(take) & set(left.columns)
    if clash:
        raise ValueError(f"rename right columns that the left side also has: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(on))]

    def known(df: DataFrame, time: str) -> Column:
        present = F.col(time).isNotNull()
        for k in on:
            present &= F.col(k).isNotNull()
        return present

    def keyed(df: DataFrame, time: str, side: int) -> DataFrame:
        piece = slice_of(time, width)
        if side == 1 and how == "left":
            # Rows that cannot match stay, spread by hash instead of meeting under the null key.
            piece = F.when(known(df, time), piece).otherwise(F.xxhash64(*df.columns))
        else:
            df = df.filter(known(df, time))
        return df.select(
            *[F.col(k).alias(a) for k, a in zip(on, keys)],
            piece.alias("_slice"),
            F.unix_micros(time).alias("_t"),
            F.lit(side).alias("_side"),
            *([F.struct(*left.columns).alias("_row")] if side == 1 else
              [F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(take)], F.lit(1).alias("one")).alias("_v"),
               *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]]),
        )

    held = [f"_o{i}" for i in range(len(order))]
    rows, versions = keyed(left, left_time, 1), keyed(right, right_time, 0)
    position = F.struct("_t", *held) if held else F.col("_t")
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    matchable = F.col("_t").isNotNull()
    for k in keys:
        matchable &= F.col(k).isNotNull()
    starts = (
        rows.filter(matchable).select(*keys, "_slice", F.lit(True).alias("_wanted"))
        .unionByName(versions.drop("_side"), allowMissingColumns=True)
        .groupBy(*keys, "_slice")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), position)).alias("_v"), F.max("_wanted").alias("_wanted"))
        .withColumn("_v", F.last("_v", ignorenulls=True).over(across))
        .filter(F.col("_wanted") & F.col("_v").isNotNull())
        .select(*keys, "_slice", "_v", F.lit(-1).alias("_side"))
    )
    within = (
        Window.partitionBy(*keys, "_slice", *(["_part"] if salts > 1 else []))
        .orderBy(F.col("_t").asc_nulls_first(), "_side", *held)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if salts > 1:
        part = F.pmod(F.xxhash64(*[F.col(f"_row.{c}") for c in left.columns]), F.lit(salts)).cast("int")
        rows = rows.withColumn("_part", part)
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        versions, starts = versions.withColumn("_part", copies), starts.withColumn("_part", copies)
    every = rows.unionByName(versions, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    every = every.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).filter(F.col("_side") == 1)
    if how == "inner":
        every = every.filter(F.col("_v").isNotNull())
    else:
        every = every.withColumn("_v", F.when(F.col("_t").isNotNull(), F.col("_v")))
    return every.select("_row.*", *[F.col(f"_v.v{i}").alias(c) for i, c in enumerate(take)])


def match_on(a: DataFrame, b: DataFrame, labels: str | Sequence[str], time: str | None = None) -> DataFrame:
    """One-to-one match of two series sets on labels; series without a partner drop out.

    More than one row per label set on a side is an error, as it is in a vector match.
    """
    labels = names(labels) + ([time] if time else [])

    def one_each(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in labels]
        once = df.groupBy(*labels).agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in others])
        refused = F.raise_error(F.lit(f"several series on the {side} side share a label set"))
        guarded = {c: F.when(F.col("_n") == 1, F.col(c)).otherwise(refused) for c in others}
        return once.withColumns(guarded).drop("_n")

    return one_each(a, "left").join(one_each(b, "right"), labels, "inner")


def stale(current: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` whose key is not in ``desired``."""
    return current.join(desired.select(*keys).distinct(), list(keys), "left_anti")


def missing_elements(df: DataFrame, declared: str, fields: DataFrame, key: str, field: str) -> DataFrame:
    """Elements of the array column ``declared`` that ``fields`` does not list for the same key."""
    wanted = df.select(key, F.explode(declared).alias(field)).distinct()
    return wanted.join(fields.select(key, field).distinct(), [key, field], "left_anti")


def aligned_diff(actual: DataFrame, desired: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key-aligned comparison: ``same``, ``changed``, ``missing`` (only desired) or ``extra`` (only actual).

    Keys are unique on each side, as configuration keys are.
    """
    keys = list(keys)
    a = actual.select(*keys, F.struct(*columns).alias("actual"), F.lit(True).alias("_a"))
    d = desired.select(*keys, F.struct(*columns).alias("desired"), F.lit(True).alias("_d"))
    state = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_d").isNull(), "extra")
        .when(F.col("actual").eqNullSafe(F.col("desired")), "same")
        .otherwise("changed")
    )
    return a.join(d, keys, "full").withColumn("state", state).drop("_a", "_d")

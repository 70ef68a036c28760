"""Comparison of what was produced with what arrived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tidemark.functions.slices import names


def reconcile(a: DataFrame, b: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """State per key: ``missing`` (only in a), ``extra`` (only in b), ``changed`` or ``same``.

    Both sides are counted and digested per key in one aggregation that combines before the shuffle,
    so repeated keys do not multiply and a hot key does not collect in one task. The rows of a key are
    compared as a multiset, by their number and the sums of two independent row hashes.
    """
    key = names(key)
    columns = list(columns) if columns is not None else [c for c in a.columns if c not in key and c in b.columns]

    def tagged(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            *key, F.lit(side).alias("_side"),
            F.xxhash64(*_digest_inputs(df, columns)).alias("_h"), F.hash(*_digest_inputs(df, columns)).alias("_g"),
        )

    every = tagged(a, "a").unionByName(tagged(b, "b"))
    exact = "decimal(38,0)"
    digests = []
    for side in ("a", "b"):
        mine = F.col("_side") == side
        digests += [
            F.count_if(mine).alias(f"rows_{side}"),
            F.sum(F.when(mine, F.col("_h")).cast(exact)).alias(f"_h_{side}"),
            F.sum(F.when(mine, F.col("_g")).cast(exact)).alias(f"_g_{side}"),
        ]
    same = F.col("rows_a") == F.col("rows_b")
    for part in ("_h", "_g"):
        same &= F.col(f"{part}_a").eqNullSafe(F.col(f"{part}_b"))
    state = (
        F.when(F.col("rows_b") == 0, "missing").when(F.col("rows_a") == 0, "extra").when(same, "same").otherwise("changed")
    )
    return every.groupBy(*key).agg(*digests).select(*key, "rows_a", "rows_b", state.alias("state"))


def _digest_inputs(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Values and null marks: Spark's hashes skip nulls, so (null, 5) and (5, null) would look alike."""
    out = []
    for c in columns:
        nested = isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        out += [F.to_json(c) if nested else F.col(c), F.col(c).isNull()]
    return out


def offset_lag(ends: DataFrame, commits: DataFrame, on=("topic", "partition"), group: str = "group") -> DataFrame:
    """End offset minus committed offset per partition and group; nothing committed counts from 0.

    ``drained`` says that the partition may be decommissioned. Ends hold one row per partition.
    """
    done = commits.groupBy(*names(on), group).agg(F.max("committed").alias("committed"))
    lag = F.greatest(F.col("end_offset") - F.coalesce(F.col("committed"), F.lit(0)), F.lit(0))
    return ends.join(done, names(on), "left").withColumn("lag", lag).withColumn("drained", F.col("lag") == 0)


def with_counters(df: DataFrame, name: str, failed: str | None = None, dead_lettered: str | None = None):
    """(DataFrame, Observation): consumed, errors and dead-lettered counts gathered while the job runs."""
    seen = Observation(name)
    zero = F.lit(0).cast("long")
    counters = [
        F.count("*").alias("consumed"),
        (F.count_if(F.col(failed)) if failed else F.max(zero)).alias("errors"),
        (F.count_if(F.col(dead_lettered)) if dead_lettered else F.max(zero)).alias("dead_lettered"),
    ]
    return df.observe(seen, *counters), seen


def run_counters(df: DataFrame, status: str = "status") -> DataFrame:
    """Bookkeeping totals from a status column (``sent``, ``error``, ``dead_letter``)."""
    return df.agg(
        F.count("*").alias("consumed"),
        F.count_if(F.col(status) == "sent").alias("sent"),
        F.count_if(F.col(status) == "error").alias("errors"),
        F.count_if(F.col(status) == "dead_letter").alias("dead_lettered"),
    )

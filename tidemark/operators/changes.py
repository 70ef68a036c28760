"""Change data: compaction, versions, differences, and applying changes to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names, with_neighbours


def _position(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def compact(
    df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], deleted: Column | None = None
) -> DataFrame:
    """Latest row per key; keys whose latest row is a tombstone disappear.

    The maximum is combined before the shuffle, so a hot key costs one row per task.
    """
    key, order = names(key), names(order)
    rest = [c for c in df.columns if c not in key]
    marked = df.withColumn("_gone", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
    latest = marked.groupBy(*key).agg(F.max_by(F.struct(*rest, "_gone"), _position(order)).alias("_last"))
    return latest.filter(~F.col("_last._gone")).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(
        *df.columns
    )


def dedupe_versions(df: DataFrame, key: str | Sequence[str], version: str) -> DataFrame:
    """One row per (key, version); a stream deduplicates within its watermark."""
    columns = [*names(key), version]
    return df.dropDuplicatesWithinWatermark(columns) if df.isStreaming else df.dropDuplicates(columns)


def version_history(
    df: DataFrame, key: str | Sequence[str], time: str, order: str | Sequence[str] = (), width=DEFAULT_SLICE
) -> DataFrame:
    """Versions with their validity: ``valid_from`` inclusive, ``valid_to`` exclusive, null while current."""
    out = with_neighbours(df, key, time, order, following={"valid_to": time}, width=width)
    return out.withColumn("valid_from", F.col(time))


def diff_change(df: DataFrame, fields: Sequence[str], before: str = "before", after: str = "after") -> DataFrame:
    """Add ``change`` (insert, delete, update, none) and ``changed_fields`` from two structs."""
    names_changed = F.array_compact(F.array(*[
        F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.lit(f)) for f in fields
    ]))
    kind = (
        F.when(F.col(before).isNull(), "insert")
        .when(F.col(after).isNull(), "delete")
        .when(F.size("changed_fields") > 0, "update")
        .otherwise("none")
    )
    return df.withColumn("changed_fields", names_changed).withColumn("change", kind)


def apply_changes(
    target: DataFrame, changes: DataFrame, key: str | Sequence[str], version: str | Sequence[str],
    deleted: str = "deleted",
) -> DataFrame:
    """The target after inserts, updates and deletes; the highest version per key wins.

    Target rows carry their own version, so a change older than the stored row does not undo it.
    """
    every = target.withColumn(deleted, F.lit(False)).withColumn("_side", F.lit(0)).unionByName(
        changes.withColumn("_side", F.lit(1)).select(*target.columns, deleted, "_side")
    )
    return compact(every, key, [*names(version), "_side"], F.col(deleted)).drop(deleted, "_side")


def release_resolved(
    rows: DataFrame, resolved: DataFrame, updated: str = "updated", mark: str = "resolved",
    stream: str | None = None, rule: str = "slowest",
) -> DataFrame:
    """Rows at or below the resolved time: nothing earlier can still arrive.

    With several feeds (``stream`` names the column in both tables) ``rule`` says whether the slowest feed decides for
    all, or each ``feed`` for itself as in the streaming form. A feed that has rows and no mark yet holds: itself under
    ``feed``, everything under ``slowest``.
    """
    if rule not in ("slowest", "feed"):
        raise ValueError(f"unknown rule {rule!r}")
    if not stream:
        return rows.filter(F.col(updated) <= resolved.agg(F.max(mark).alias(mark)).scalar())
    newest = resolved.groupBy(stream).agg(F.max(mark).alias("_gate"))
    if rule == "feed":
        named = newest.withColumnRenamed(stream, "_feed")
        return rows.join(named, F.col(stream) == F.col("_feed")).filter(F.col(updated) <= F.col("_gate")).select(rows.columns)
    feeds = newest if stream not in rows.columns else newest.join(rows.select(stream).distinct(), stream, "full")
    gate = feeds.agg(F.when(F.count(F.when(F.col("_gate").isNull(), 1)) == 0, F.min("_gate"))).scalar()
    return rows.filter(F.col(updated) <= gate)


def snapshot_then_changes(
    snapshot: DataFrame, changes: DataFrame, key: str | Sequence[str], version: str, deleted: str = "deleted"
) -> DataFrame:
    """Current state from an initial snapshot and the changes after it, without gap or double count."""
    fresh = dedupe_versions(changes, key, version)
    return apply_changes(snapshot, fresh, key, version, deleted)


def id_diff(base: DataFrame, head: DataFrame, key: str = "id") -> DataFrame:
    """IDs only in one input, as ``removed`` or ``added``; one shuffle of distinct IDs."""
    both = base.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_h")).unionByName(
        head.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_h"))
    )
    return (
        both.groupBy(key)
        .agg(F.max("_b").alias("_b"), F.max("_h").alias("_h"))
        .filter(F.col("_b") != F.col("_h"))
        .select(key, F.when(F.col("_b") == 1, "removed").otherwise("added").alias("change"))
    )

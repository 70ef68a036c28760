"""Tables kept as parquet folders that streams write batch by batch.

Every batch writes its own ``_batch=<id>`` folder and a repeated delivery overwrites it, so writing is
idempotent and costs as much as the batch. Keyed tables are merged when read, and ``fold`` writes the
merged state as a new base when many batches have gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.slices import names
from tidemark.operators.changes import compact

BATCH = "_batch"


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def write_batch(batch: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    writer = batch.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


class _Foldable:
    """Batches of changes, and bases that hold the state after a batch.

    A ledger row points to a base only once it is complete; readers take the newest one and the batches
    after it.
    """

    path: str

    def _folded(self, spark: SparkSession) -> int | None:
        ledger = f"{self.path}/ledger"
        return spark.read.parquet(ledger).agg(F.max("upto")).first()[0] if exists(spark, ledger) else None

    def _parts(self, spark: SparkSession, upto: int | None = None) -> tuple[DataFrame | None, DataFrame]:
        """(newest base or None, the batches after it), optionally only up to a batch."""
        changes, folded = read_batches(spark, f"{self.path}/changes"), self._folded(spark)
        if upto is not None:
            changes = changes.filter(F.col(BATCH) <= upto)
        if folded is None:
            return None, changes
        base = spark.read.parquet(f"{self.path}/base/upto={folded}").withColumn(BATCH, F.lit(folded))
        return base, changes.filter(F.col(BATCH) > folded)

    def _write_base(self, spark: SparkSession, state: DataFrame, upto: int) -> None:
        folded = self._folded(spark)
        if folded is not None and folded >= upto:
            return
        state.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        spark.range(1).select(F.lit(upto).cast("int").alias("upto")).write.mode("append").parquet(f"{self.path}/ledger")


class KeyedTable(_Foldable):
    """Latest row per key, from a stream of upserts and deletes.

    ``order`` decides which of several rows of a key in one batch counts; across batches the later
    batch wins. ``deleted`` names a boolean column that marks deletes.
    """

    def __init__(self, path: str, key: str | Sequence[str], order: str | Sequence[str], deleted: str | None = None):
        self.path, self.key, self.order, self.deleted = path, names(key), names(order), deleted

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        write_batch(compact(batch, self.key, self.order), f"{self.path}/changes", batch_id)

    def _merged(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Base rows that no later batch touches, and the latest of the others.

        The base has one row per key and is only tested for presence, so it is not aggregated again;
        while the changes since then are small, Spark sends their keys to it.
        """
        base, changes = self._parts(spark, upto)
        latest = compact(changes, self.key, BATCH)
        if base is not None:
            latest = base.join(latest.select(*self.key), self.key, "left_anti").select(*latest.columns).unionByName(latest)
        if self.deleted:
            latest = latest.filter(~F.coalesce(F.col(self.deleted), F.lit(False)))
        return latest.drop(BATCH)

    def read(self, spark: SparkSession) -> DataFrame:
        merged = self._merged(spark)
        return merged.drop(self.deleted) if self.deleted else merged

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Write the state after batch ``upto`` as the new base."""
        self._write_base(spark, self._merged(spark, upto), upto)


class DocumentTable(_Foldable):
    """Documents by key with insert and modify times.

    A row without value (``deleted``) removes the document. ``strategy`` is ``replace`` (the row is the
    document), ``update`` (its non-null fields are set) or ``delete`` (every row removes its key).
    """

    def __init__(self, path: str, key: str | Sequence[str], order: str, time: str, deleted: str, strategy: str = "update"):
        if strategy not in ("update", "replace", "delete"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.path, self.key, self.order, self.time = path, names(key), order, time
        self.deleted, self.strategy = deleted, strategy

    def _fields(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (*self.key, self.order, self.time, self.deleted, BATCH)
                and not c.startswith("_")]

    def _picked(self, column: str, position: Column) -> Column:
        """The last value, for updates the last non-null one."""
        if self.strategy == "update":
            position = F.when(F.col(column).isNotNull(), position)
        return F.max_by(column, position).alias(column)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One row per key and batch: what is left after the batch's last delete of the key."""
        gone = F.lit(True) if self.strategy == "delete" else F.coalesce(F.col(self.deleted), F.lit(False))
        batch = batch.withColumn("_gone", gone)
        removed = batch.filter("_gone").groupBy(*self.key).agg(F.max(self.order).alias("_removed"))
        rows = batch.join(removed, self.key, "left")
        alive = F.col("_removed").isNull() | (F.col(self.order) > F.col("_removed"))
        at = F.when(alive, F.col(self.order))
        reduced = rows.groupBy(*self.key).agg(
            *[self._picked(c, at) for c in self._fields(batch)],
            F.max("_removed").isNotNull().alias("_reset"), F.max(at).isNull().alias("_gone"),
            F.min_by(self.time, at).alias("_first"), F.max_by(self.time, at).alias("_last"),
        )
        write_batch(reduced, f"{self.path}/changes", batch_id)

    def _merged(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """A key has one row per batch since the last fold, so the ordered pass over it is that long."""
        base, rows = self._parts(spark, upto)
        if base is not None:
            rows = base.unionByName(rows)
        w = Window.partitionBy(*self.key).orderBy(BATCH)
        rows = rows.withColumn("_life", F.sum(F.when(F.col("_reset"), 1).otherwise(0)).over(w))
        rows = rows.withColumn("_newest", F.max("_life").over(Window.partitionBy(*self.key)))
        rows = rows.filter((F.col("_life") == F.col("_newest")) & ~F.col("_gone"))
        return rows.groupBy(*self.key).agg(
            *[self._picked(c, F.col(BATCH)) for c in self._fields(rows)],
            F.min_by("_first", BATCH).alias("inserted_ts"), F.max_by("_last", BATCH).alias("modified_ts"),
        )

    def read(self, spark: SparkSession) -> DataFrame:
        return self._merged(spark)

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Write the documents after batch ``upto`` as the new base."""
        state = self._merged(spark, upto).withColumnsRenamed({"inserted_ts": "_first", "modified_ts": "_last"})
        self._write_base(spark, state.withColumns({"_reset": F.lit(True), "_gone": F.lit(False)}), upto)


class SchematizedTable:
    """Append table that gains columns as rows bring them, and takes each channel offset once."""

    def __init__(self, path: str, channel: str | Sequence[str], offset: str):
        self.path, self.channel, self.offset = path, names(channel), offset

    def committed(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """Highest offset per channel after the newest batch, or the newest one before ``before``."""
        ledger = f"{self.path}/offsets"
        if not exists(spark, ledger):
            return None
        offsets = read_batches(spark, ledger)
        if before is not None:
            offsets = offsets.filter(F.col(BATCH) < before)
        newest = offsets.agg(F.max(BATCH)).first()[0]
        return None if newest is None else offsets.filter(F.col(BATCH) == newest).drop(BATCH)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Rows at or below their channel's committed offset were written before and are left out."""
        spark = batch.sparkSession
        done = self.committed(spark, batch_id)
        if done is not None:
            batch = batch.join(done, self.channel, "left").filter(
                F.col("committed").isNull() | (F.col(self.offset) > F.col("committed"))
            ).drop("committed")
        once = batch.dropDuplicates([*self.channel, self.offset])
        write_batch(once, f"{self.path}/rows", batch_id)
        written = spark.read.parquet(f"{self.path}/rows/{BATCH}={batch_id}")
        marks = written.select(*self.channel, F.col(self.offset).alias("committed"))
        marks = marks.unionByName(done) if done is not None else marks
        # Every batch keeps the offsets of all channels, so the next one reads a single batch.
        write_batch(marks.groupBy(*self.channel).agg(F.max("committed").alias("committed")), f"{self.path}/offsets", batch_id)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, f"{self.path}/rows", merge_schema=True).drop(BATCH)


def to_key_value(
    df: DataFrame, key: str, prefix: str, time: str, ttl_s: int | Column | None, order: str | Sequence[str] = ()
) -> DataFrame:
    """Latest value per prefixed key with its expiry time; a null time to live never expires."""
    order = names(order) or [time]
    rest = [c for c in df.columns if c != key]
    newest = compact(df, key, order)
    ttl = ttl_s if isinstance(ttl_s, Column) else F.lit(ttl_s).cast("long")
    return newest.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"),
        F.to_json(F.struct(*rest)).alias("value"),
        F.timestamp_micros(F.unix_micros(time) + ttl * F.lit(1000000)).alias("expires_at"),
    )


def live_entries(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def merge_table(batch: DataFrame, table: str, key: str | Sequence[str], order: str | Sequence[str]) -> None:
    """Upsert into a catalog table whose format supports row-level changes. Untested here."""
    key = names(key)
    match = F.lit(True)
    for k in key:
        match &= F.col(f"{table}.{k}") == F.col(f"changes.{k}")
    source = compact(batch, key, order).alias("changes")
    source.mergeInto(table, match).whenMatched().updateAll().whenNotMatched().insertAll().merge()

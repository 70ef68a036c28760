"""A stream's table whose fields are encrypted, with keys that can be wrapped anew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.privacy import decrypt_fields, encrypt_fields, master_keys, new_keyring

_KEYS = "batch bigint, generation int, key_id string, wrapped_key binary"


class SealedTable:
    """A handler for ``run_stream``: each batch is encrypted with fresh data keys, one for each key id.

    Rows hold ciphertext and the key id; the wrapped data keys are in a table beside them, one row for each batch and key id.
    ``rewrap`` adds the same data keys wrapped by other master keys as a further generation and reads no row of data. A batch that is delivered
    again overwrites its keys and its rows. A null field stays null; a row without a known key id fails the batch.
    """

    def __init__(self, path: str, fields: Sequence[str], masters: Mapping[str, bytes]) -> None:
        self.path, self.fields, self.masters = path, list(fields), dict(masters)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        ring = new_keyring(batch.sparkSession, self.masters)
        keys = ring.select(F.lit(0).alias("generation"), "key_id", "wrapped_key").coalesce(1)
        keys.write.mode("overwrite").partitionBy("generation").parquet(f"{self.path}/keys/batch={batch_id}")
        encrypt_fields(batch, self.fields, ring).drop("wrapped_key").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def keys(self, spark: SparkSession, generation: int | None = None) -> DataFrame:
        """(batch, key_id, generation, wrapped_key): the newest generation of each data key, up to ``generation``."""
        whole = spark.read.option("basePath", f"{self.path}/keys").schema(_KEYS).parquet(f"{self.path}/keys")
        known = whole if generation is None else whole.filter(F.col("generation") <= generation)
        newest = known.groupBy("batch", "key_id").agg(F.max(F.struct("generation", "wrapped_key")).alias("k"))
        return newest.select("batch", "key_id", "k.*")

    def rewrap(self, spark: SparkSession, masters: Mapping[str, bytes]) -> None:
        """Wrap every data key by ``masters`` instead of the master keys so far, which later batches use as well.

        If it fails half-way, call it again: what is already there opens with the new keys and is left as it is.
        """
        old, new = master_keys(spark, self.masters), master_keys(spark, masters)
        held = self.keys(spark).join(old, "key_id").join(new.withColumnRenamed("master_key", "_new"), "key_id", "left")
        target = F.coalesce(F.col("_new"), F.raise_error(F.lit("no new master key for this key id")).cast("binary"))
        plain = F.try_aes_decrypt("wrapped_key", "master_key")
        done = F.try_aes_decrypt(F.col("wrapped_key"), target).isNotNull()
        fresh = held.filter(~done).select("batch", (F.col("generation") + 1).alias("generation"), "key_id", F.aes_encrypt(plain, target).alias("wrapped_key"))
        fresh.coalesce(1).write.mode("append").partitionBy("batch", "generation").parquet(f"{self.path}/keys")
        self.masters = dict(masters)

    def sealed(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The rows as they are stored, ``schema`` being that of the batches, with their ``batch``."""
        stored = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in self.fields else f for f in schema])
        return spark.read.option("basePath", f"{self.path}/rows").schema(f"{stored.toDDL()}, batch bigint").parquet(f"{self.path}/rows")

    def opened(self, spark: SparkSession, schema: T.StructType, masters: Mapping[str, bytes], generation: int | None = None) -> DataFrame:
        """The rows in clear, by the master keys of the newest generation or of ``generation``."""
        rows = self.sealed(spark, schema).join(self.keys(spark, generation).drop("generation"), ["batch", "key_id"])
        return decrypt_fields(rows, self.fields, master_keys(spark, masters)).select(*schema.names)

"""Field encryption with wrapped data keys.

A keyring holds one row per key id: the data key and its wrapped form. Keys travel in DataFrames that
the caller builds at run time, not as literals, so they appear in no plan text. They are local relations
of known size, so Spark sends them to the data and the data is not shuffled by key id.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import listed

_MASTER = "key_id string, master_key binary"


def master_keys(spark: SparkSession, keys: Mapping[str, bytes]) -> DataFrame:
    return listed(spark, {"key_id": list(keys), "master_key": list(keys.values())}, _MASTER)


def new_keyring(spark: SparkSession, masters: Mapping[str, bytes]) -> DataFrame:
    """A fresh 256-bit data key per key id, wrapped by its master key.

    The keyring is small and is materialised here once, so that every later use sees the same keys.
    """
    columns = {"key_id": list(masters), "master_key": list(masters.values()), "data_key": [os.urandom(32) for _ in masters]}
    plain = listed(spark, columns, f"{_MASTER}, data_key binary")
    rows = plain.select("key_id", "data_key", F.aes_encrypt("data_key", "master_key").alias("wrapped_key")).collect()
    sealed = {c: [bytes(r[c]) if c != "key_id" else r[c] for r in rows] for c in ("key_id", "data_key", "wrapped_key")}
    return listed(spark, sealed, "key_id string, data_key binary, wrapped_key binary")


def encrypt_fields(df: DataFrame, fields: Sequence[str], keyring: DataFrame, key_id: str = "key_id") -> DataFrame:
    """Encrypt the named string fields (AES-GCM); the rest stays readable. Adds ``wrapped_key``.

    A row whose key id is not in the keyring fails the job rather than passing in clear.
    """
    ring = keyring.withColumnRenamed("key_id", key_id)
    joined = df.join(ring, key_id, "left")
    key = F.coalesce(F.col("data_key"), F.raise_error(F.lit("no data key for this key id")).cast("binary"))
    sealed = {f: F.aes_encrypt(F.col(f).cast("binary"), key, F.lit("GCM")) for f in fields}
    return joined.withColumns(sealed).drop("data_key")


def decrypt_fields(
    df: DataFrame, fields: Sequence[str], masters: DataFrame, key_id: str = "key_id", strict: bool = True
) -> DataFrame:
    """Decrypt the named fields with the row's wrapped key.

    Without the master key the job fails; with ``strict=False`` the fields become null and
    ``decrypt_failed`` says so, for counting failures.
    """
    ring = masters.withColumnRenamed("key_id", key_id)
    joined = df.join(ring, key_id, "left")
    if strict:
        master = F.coalesce(F.col("master_key"), F.raise_error(F.lit("no master key for this key id")).cast("binary"))
        opened = joined.withColumn("_key", F.aes_decrypt("wrapped_key", master))
        return opened.withColumns(
            {f: F.aes_decrypt(F.col(f), F.col("_key"), F.lit("GCM")).cast("string") for f in fields}
        ).drop("_key", "master_key", "wrapped_key")
    opened = joined.withColumn("_key", F.try_aes_decrypt(F.col("wrapped_key"), F.col("master_key")))
    tried = {f: F.try_aes_decrypt(F.col(f), F.col("_key"), F.lit("GCM")).cast("string") for f in fields}
    failed = F.lit(False)
    for f in fields:
        failed |= F.col(f).isNotNull() & tried[f].isNull()
    return opened.withColumn("decrypt_failed", failed).withColumns(tried).drop("_key", "master_key", "wrapped_key")


def pii_inventory(schemas: DataFrame, document: str = "document") -> DataFrame:
    """Tagged fields (``doc`` is ``PII``) per subject, from registered schema documents."""
    fields = F.from_json(F.get_json_object(document, "$.fields"), "array<struct<name:string,doc:string>>")
    rows = schemas.select(*[c for c in schemas.columns if c != document], F.explode(fields).alias("_f"))
    return rows.filter(F.col("_f.doc") == "PII").withColumn("field", F.col("_f.name")).drop("_f")

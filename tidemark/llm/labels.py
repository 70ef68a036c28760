"""Bounded training samples of labelled documents and the folds that keep held-out rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored
from tidemark.llm.minhash import signed


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether CRC-32 of the key as text leaves ``part`` modulo ``parts``; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(parts)) == part, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, parts: int, part: int, per_class: int) -> DataFrame:
    """(text, label) of up to ``per_class`` labelled rows of each label outside the held-out fold.

    Those with the least hash of their key are taken, so the sample depends on the keys alone. Of near copies
    (by MinHash slots) mostly one is left, so that they don't stand for a class. Null labels and keys are left out.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(~held_out(F.col("key"), parts, part)).withColumn("h", F.xxhash64("key", F.lit(29)))
    chosen = None
    for value in (0, 1):
        some = rows.where(F.col("label") == value).orderBy("h", "key").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    chosen = stored(chosen.dropDuplicates(["key"]), "labels")
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(texts.join(chosen, "key"), "sample")
    slots = signed(found, "key", "text").groupBy("key").agg(F.min("sig").alias("sig"))
    found = found.join(slots, "key")
    for chunk in range(3):  # near copies share the least of their shingles' hashes more often than not, three times over
        slot = F.when(F.col("sig")[chunk] != 0, F.col("sig")[chunk].bitwiseAND(F.lit(0xFFFF)) * 3 + chunk).otherwise(F.xxhash64("key"))
        place = F.xxhash64(slot, F.col("sig")[chunk + 3].bitwiseAND(F.lit(0xFFFF)))
        first = Window.partitionBy("place", "label").orderBy(F.xxhash64("key", F.lit(29)), "key", F.sha2("text", 256))
        found = found.withColumn("place", place).withColumn("n", F.row_number().over(first)).where("n = 1").drop("place", "n")
    return stored(found.select("key", "text", "label"), "sample")

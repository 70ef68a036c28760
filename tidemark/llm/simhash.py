"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

A term is a pair of neighbouring words (a text of one word is one term). Its 128-bit hash votes on every bit with
weight 1 + log2(frequency). Tables for the search: the bits are cut into blocks, and a table for each choice of
``blocks - radius`` blocks puts these in front; two fingerprints within the radius agree on all of them in some table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ASCII_SPACE, column_bytes, constants, mixed, slices, stored, word_hashes

BITS = 128
_PAIR = constants(4, 5)
PACKED = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("peek", pa.bool_()), ("name", pa.binary()), ("fingerprint", pa.binary()), ("packed", pa.binary())])


def fingerprints(column: pa.Array) -> np.ndarray:
    """(rows, 16) bytes: the fingerprint of each text. Texts without words, empty and null ones have all bits clear."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for a, b in slices(column):
        words, counts = word_hashes(*column_bytes(column.slice(a, b - a)), ASCII_SPACE)
        ends = np.cumsum(counts)
        for i, (end, n) in enumerate(zip(ends, counts)):
            if n:
                out[a + i] = _votes(words[end - n : end])
    return out


def _votes(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        terms = mixed(words[:-1] * _PAIR[0] + words[1:] * _PAIR[1]) if len(words) > 1 else words
        terms, often = np.unique(terms, return_counts=True)
        both = np.stack([mixed(terms * _PAIR[2]), mixed(terms ^ _PAIR[3])], axis=1)
    total = np.zeros(BITS, np.float32)
    weight = (1 + np.log2(often)).astype(np.float32)
    for i in range(0, len(terms), 1 << 16):
        signs = np.unpackbits(both[i : i + (1 << 16)].view(np.uint8), axis=1).astype(np.float32)
        total += weight[i : i + (1 << 16)] @ (2 * signs - 1)
    return np.packbits(total > 0)


def with_fingerprint(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fingerprint as 16 bytes) of every row; repeated rows stay."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [x.tobytes() for x in fingerprints(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.binary())], names=["key", "fingerprint"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fingerprint binary").select(F.col("key").alias(key), "fingerprint")


def distance(a: str, b: str):
    """Differing bits of two fingerprints given as two longs each (columns ``a``.hi, ``a``.lo ...)."""
    return sum(F.bit_count(F.col(f"{a}_{part}").bitwiseXOR(F.col(f"{b}_{part}"))) for part in ("hi", "lo"))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Every pair of different fingerprints (low, high) with at most ``radius`` differing bits, and the bits.

    Equal fingerprints are one row here: join back on the fingerprint for the texts that have it, so a group of copies
    costs nothing. A table's key has 128 * (blocks - radius) / blocks bits. ``blocks`` must exceed ``radius``.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    hexed = F.hex("fingerprint")
    one = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    one = one.select("fingerprint", *[F.conv(F.substring(hexed, at, 16), 16, -10).cast("bigint").alias(n) for at, n in ((1, "hi"), (17, "lo"))])
    bits = np.linspace(0, BITS, blocks + 1).round().astype(int)
    tables = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        masks = [0, 0]
        for block in chosen:
            for bit in range(bits[block], bits[block + 1]):
                masks[bit // 64] |= 1 << (63 - bit % 64)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        tables.append(F.xxhash64(F.lit(number), F.col("hi").bitwiseAND(F.lit(signed[0])), F.col("lo").bitwiseAND(F.lit(signed[1]))))
    rows = one.select("hi", "lo", F.explode(F.array(*tables)).alias("place"))
    several = rows.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place")
    rows = stored(rows.join(several, "place"), "simhash")
    left = rows.select("place", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    right = rows.select("place", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    ordered = (F.col("a_hi") < F.col("b_hi")) | ((F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo")))
    pairs = left.join(right, "place").where(ordered & (distance("a", "b") <= radius))
    text = lambda s: F.unhex(F.concat(*[F.lpad(F.hex(f"{s}_{p}"), 16, "0") for p in ("hi", "lo")]))
    return pairs.select(text("a").alias("low"), text("b").alias("high"), distance("a", "b").cast("int").alias("bits")).distinct()


def _edited(text: str, after: str | None) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + (after or "")[:half]


def edited_neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each text's fingerprint beside those of its edited form and of the next text.

    The next text is that of the next lower key (rows of one key by their text's digest, null keys behind, the first row after the
    last one). The edited form has the text's last half (rounded down) replaced by as much of the next text's start.
    The only row of a table is its own next one.

    Rows meet in ranges of the key, whose bounds are quantiles; the first row of each range is sent to the range before
    as well. Texts move once, compressed. ``key`` is an integer column; other columns are not read.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    def ranges(keys: pa.Array) -> np.ndarray:
        """The number of bounds above the key, so ranges run as keys descend; null keys come last."""
        numbers = len(bounds) - np.searchsorted(bounds, pc.fill_null(keys, 0).to_numpy(), side="right")
        numbers[pc.is_null(keys).to_numpy(zero_copy_only=False)] = len(bounds) + 1
        return numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranges(batch.column("key")), pa.int64()), batch.column("key")], names=["part", "key"])

    placed = rows.select("key").mapInArrow(place, "part bigint, key bigint")
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.max("key").alias("head")).collect()}  # at most parts + 1
    order = sorted(heads)
    before = dict(zip(order, order[-1:] + order[:-1]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            numbers = ranges(batch.column("key"))
            prints = [x.tobytes() for x in fingerprints(batch.column("text"))]
            out: dict[str, list] = {n: [] for n in PACKED.names}
            for a, b in slices(batch.column("text")):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                for key_, part, fp, t in zip(batch.column("key").slice(a, b - a).to_pylist(), numbers[a:b].tolist(), prints[a:b], texts):
                    raw = (t or "").encode()
                    row = (hashlib.sha256(raw).digest(), fp, squeeze.compress(raw))
                    for to, peek in ((part, False), (before[part], True)):
                        if not peek or key_ == heads[part]:
                            for name, value in zip(PACKED.names, (key_, to, peek, *row)):
                                out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=PACKED)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = zstandard.ZstdDecompressor()
        held = None  # the row that waits for the next one of its range

        def joined(rows: list[tuple]) -> pd.DataFrame:
            texts = [opened.decompress(r[3]).decode() for r, _ in rows]
            afters = [opened.decompress(n[3]).decode() for _, n in rows]
            edited = [_edited(t, n) for t, n in zip(texts, afters)]
            prints = [x.tobytes() for x in fingerprints(pa.array(edited, pa.large_string()))]
            alike = lambda a, b: 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS
            return pd.DataFrame({
                "key": pd.array([r[0] for r, _ in rows], dtype="Int64"), "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [r[2].hex() for r, _ in rows], "edited_fingerprint": [p.hex() for p in prints],
                "near_edited": [alike(r[2], p) for (r, _), p in zip(rows, prints)], "near_next": [alike(r[2], n[2]) for r, n in rows],
            })

        for batch in batches:
            ready: list[tuple] = []
            size = 0
            for key_, part, peek, fp, packed in zip(batch["key"], batch["part"], batch["peek"], batch["fingerprint"], batch["packed"]):
                row = (None if pd.isna(key_) else int(key_), part, bytes(fp), bytes(packed))
                if held is not None and held[1] == part:
                    ready.append((held, row))
                    size += len(held[3])
                held = None if peek else row
                if size > 1 << 20:
                    yield joined(ready)
                    ready, size = [], 0
            if ready:
                yield joined(ready)

    packed = rows.mapInArrow(pack, "key bigint, part bigint, peek boolean, name binary, fingerprint binary, packed binary")
    near = packed.repartition(max(parts // 2, 1), "part").sortWithinPartitions("part", "peek", F.desc_nulls_last("key"), "name").drop("name")
    shape = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return near.mapInPandas(compare, shape).withColumnRenamed("key", key)

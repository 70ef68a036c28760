"""Helpers shared by the text operators: working tables, batches of text, words and their hashes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import fresh_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE = 1 << 21
ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these settings inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, with_settings: dict[str, str] | None = None) -> DataFrame:
    """The same rows from a table in the shared folder; the shuffle files of the job go when the table is there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, {CLEANUP: "true"} | (with_settings or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that follow from the seed."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * _GOLDEN) | np.uint64(1)


_BYTE = constants(256, 1)
_powers = constants(64, 2)


def _place_weights(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = constants(1 << int(n - 1).bit_length(), 2)
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and how many words each row has.

    A word is a longest run of bytes that are no separators; it never crosses rows. ``lower`` folds A-Z.
    The bytes are taken in slices that end between words, so memory follows the number of words.
    """
    hashes, rows = [], []
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    a = 0
    while a < len(data):
        b = min(a + SLICE, len(data))
        if b < len(data):
            ends = np.flatnonzero(separator[data[a:b]] | cut[a + 1 : b + 1])
            while not len(ends) and b < len(data):  # one word longer than the slice
                b = min(b + SLICE, len(data))
                ends = np.flatnonzero(separator[data[a:b]] | cut[a + 1 : b + 1])
            if len(ends):
                b = a + int(ends[-1]) + 1
        part = data[a:b]
        inside = ~separator[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[a + 1 : b]
        starts = np.flatnonzero(first)
        if len(starts):
            here = part[starts[0] :]
            at = starts - starts[0]
            spans = np.diff(np.append(at, len(here)))
            place = np.arange(len(here)) - np.repeat(at, spans)
            with np.errstate(over="ignore"):
                votes = _BYTE[_LOWER[here] if lower else here] * _place_weights(int(spans.max()) + 1)[place]
                votes[~inside[starts[0] :]] = 0
                size = np.add.reduceat(inside[starts[0] :].astype(np.uint64), at)
                hashes.append(mixed(np.add.reduceat(votes, at) + size * _GOLDEN))
            rows.append(np.searchsorted(bounds, starts + a, side="right") - 1)
        a = b
    counts = np.zeros(len(bounds) - 1, np.int64)
    if hashes:
        np.add.at(counts, np.concatenate(rows), 1)
        return np.concatenate(hashes), counts
    return np.zeros(0, np.uint64), counts


def slices(column: pa.Array, most: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of about ``most`` bytes each; a longer row is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def tiles(starts: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of row ranges of up to ``most`` rows that hold all pairs of rows of one block, whose bounds are ``starts``; a range is whole
    blocks, or a part of one.
    """
    i = 0
    while i + 1 < len(starts):
        j = max(int(np.searchsorted(starts, starts[i] + most, side="right")) - 1, i + 1)
        cuts = np.append(np.arange(starts[i], starts[j], most), starts[j]).tolist() if j == i + 1 else [int(starts[i]), int(starts[j])]
        for k in range(len(cuts) - 1):
            for m in range(k, len(cuts) - 1):
                yield slice(cuts[k], cuts[k + 1]), slice(cuts[m], cuts[m + 1])
        i = j

"""Removal of repeated passages: bytes covered by a string of LENGTH bytes that also starts in an earlier document.

Equal texts are one from the start. Texts are dealt into parts of a bounded size. A window of LENGTH bytes is named by
the least hash of the 24-byte strings in it, so equal windows have equal names; consecutive windows with one name are a
run, some 14 windows long. Names that occur twice are found by exchanging each part's names. Only runs with such names
go on, as strings, each distinct one of a part once, to shards by name. A shard orders all suffixes of its strings by
external induced sorting, equal strings of several parts once; neighbours whose common prefix has LENGTH bytes are one window, and the least document of
their strings is its owner. Owners go back to the parts, where covered bytes are cut out.

A name, a line or a passage that very many documents share is one entry for each part, not for each document. Different
strings with one name, as around a common phrase of 24 bytes, go to one shard; a name whose strings have more than
``NAME_BYTES`` is dealt by its single windows instead, each distinct one of a part once, to further shards by the
window's hash, as many as keep these to that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import constants, mixed, stored
from tidemark.llm.induced import equal_groups

LENGTH = 50
GRAM = 24
PART_BYTES = 8 << 20
NAME_BYTES = 8 << 20
PIECE = 1 << 21
_BYTE = constants(256, 31)
_STEP = constants(8, 37)
LAST = (1 << 63) - 1  # stands for a null key: after all others


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, end of starts) of the runs of windows of one text, in pieces so that memory stays bounded."""
    names, firsts, ends = [], [], []
    windows = len(data) - LENGTH + 1
    for a in range(0, windows, PIECE):
        part = data[a : min(a + PIECE, windows) + LENGTH - 1]
        with np.errstate(over="ignore"):
            h = _BYTE[part]
            for i, size in enumerate((1, 2, 4, 8)):
                h = h[:-size] * _STEP[2 * (i % 4)] + h[size:] * _STEP[2 * (i % 4) + 1]
                h ^= h >> np.uint64(29)
                if size == 4:
                    eight = h
            h = mixed(h[: len(h) - (GRAM - 16)] * _STEP[0] + eight[16:][: len(h) - (GRAM - 16)] * _STEP[3]) | np.uint64(1)
        width, least = 1, h
        while 2 * width <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = LENGTH - GRAM + 1 - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
        cuts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        names.append(least[cuts])
        firsts.append(cuts + a)
        ends.append(np.append(cuts[1:], len(least)) + a)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(firsts), np.concatenate(ends)


def _texts(packed: pd.DataFrame) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(key, name, bytes) of a part's texts in a fixed order."""
    opened = zstandard.ZstdDecompressor()
    rows = sorted((int(k), bytes(n), d) for k, n, d in zip(packed["key"], packed["name"], packed["data"]))
    for key, name, data in rows:
        yield key, name, np.frombuffer(opened.decompress(bytes(data)), np.uint8)


def _part_names(packed: pd.DataFrame) -> np.ndarray:
    """The distinct names of a part; the lowest bit tells whether two of its texts have the name."""
    found = [np.unique(runs(data)[0]) for _, _, data in _texts(packed)]
    names, often = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return np.where(often > 1, names, names ^ np.uint64(1))


def _shard(name: int, raw: bytes, parts: int, heavy: frozenset[int], more: int) -> int:
    if name in heavy:
        return parts + int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest()) % more
    return (name >> 1) % parts


class _Strings:
    """A part's distinct strings with repeated names, and where its texts have them, as (numbers, starts) of each text in
    order. Those of ``heavy`` names are windows.
    """

    def __init__(self, packed: pd.DataFrame, repeated: np.ndarray, heavy: frozenset[int] = frozenset()):
        self.place: dict[tuple[int, bytes], int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.uses: list[tuple[list[int], list[int]]] = []
        for key, _, data in _texts(packed):
            names, firsts, ends = runs(data)
            found = repeated[np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)] == names if len(repeated) else np.zeros(len(names), bool)
            raw, own, starts = data.tobytes(), [], []
            some = zip(names[found].tolist(), firsts[found].tolist(), ends[found].tolist())
            if heavy:
                some = ((h, c, d) for h, a, b in some for c, d in (((i, i + 1) for i in range(a, b)) if h in heavy else ((a, b),)))
            for h, a, b in some:
                number = self.place.setdefault((h, raw[a : b + LENGTH - 1]), len(self.place))
                if number == len(self.low):
                    self.low.append(key)
                    self.high.append(key)
                else:
                    self.high[number] = key  # keys rise
                own.append(number)
                starts.append(a)
            self.uses.append((own, starts))


def _names_of(blobs) -> np.ndarray:
    found = [np.frombuffer(bytes(b), np.uint64) for b in blobs if b is not None]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


PART, BUCKET = "part bigint", "bucket bigint"


def _exchange(packed: DataFrame, parts: int) -> DataFrame:
    """(part, data): the names of each part that some other text has as well."""
    def names(rows: pd.DataFrame) -> pd.DataFrame:
        found = _part_names(rows)
        bucket = ((found >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(found[order], np.flatnonzero(np.diff(bucket[order])) + 1) if len(found) else []
        buckets = np.unique(bucket)
        return pd.DataFrame({"part": np.full(len(buckets), rows["part"].iloc[0]), "bucket": buckets, "data": [g.tobytes() for g in groups]})

    def common(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = [np.frombuffer(bytes(b), np.uint64) for b in rows["data"]]
        found, often = np.unique(np.concatenate(blobs) | np.uint64(1), return_counts=True)
        several = np.concatenate([b[(b & np.uint64(1)) == 1] for b in blobs])
        repeated = np.union1d(found[often > 1], several)
        kept = [b[np.isin(b | np.uint64(1), repeated, assume_unique=True)] | np.uint64(1) for b in blobs]
        return pd.DataFrame({"part": rows["part"], "data": [k.tobytes() for k in kept]})

    sent = packed.groupBy("part").applyInPandas(names, f"{PART}, {BUCKET}, data binary")
    return sent.groupBy("bucket").applyInPandas(common, f"{PART}, data binary").where("octet_length(data) > 0")


def _both(packed: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of each part: texts (kind 0), then the ``data`` of each other table (1, 2)."""
    rows = packed.select("part", F.lit(0).alias("kind"), "key", "name", "data")
    for kind, df in enumerate(others, 1):  # without nulls, which would make floats of the keys
        rows = rows.union(df.select("part", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("key"), F.lit(b"").alias("name"), "data"))
    return rows


def _strings(packed: DataFrame, repeated: DataFrame, parts: int, name_bytes: int, heavy: frozenset[int] = frozenset(), more: int = 0) -> DataFrame:
    """(part, bucket, numbers, sizes, low, high, data): the parts' strings, by shard.

    Bucket -1 has the names, as ``numbers``, whose strings have more bytes in the part, as ``sizes``, than half its share
    of ``name_bytes``: without what is less, a name beyond the bound still has half of it. Bucket -2 has, as ``data``, where the
    part's texts have its strings: how many texts, how many uses in each, their strings' numbers and their starts.
    """
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Strings(rows[rows["kind"] == 0], _names_of(rows.loc[rows["kind"] == 1, "data"]), heavy)
        out: dict[int, list[tuple[int, bytes]]] = {}
        for (h, raw), number in found.place.items():
            out.setdefault(_shard(h, raw, parts, heavy, more), []).append((number, raw))
        array = lambda values: np.array(values, np.int64).tobytes()
        names, which = np.unique(np.fromiter((h for h, _ in found.place), np.uint64, len(found.place)), return_inverse=True)
        held = np.bincount(which, np.fromiter((len(raw) for _, raw in found.place), np.int64, len(found.place)), len(names)).astype(np.int64)
        much = held > name_bytes // (2 * parts)
        counts = [] if heavy or not much.any() else [{
            "part": rows["part"].iloc[0], "bucket": -1, "numbers": names[much].tobytes(), "sizes": held[much].tobytes(), "low": b"", "high": b"", "data": b""}]
        uses = array([len(found.uses), *(len(own) for own, _ in found.uses)]) + b"".join(array(own) for own, _ in found.uses) + b"".join(array(starts) for _, starts in found.uses)
        counts.append({"part": rows["part"].iloc[0], "bucket": -2, "numbers": b"", "sizes": b"", "low": b"", "high": b"", "data": uses})
        return pd.DataFrame(counts + [{
            "part": rows["part"].iloc[0], "bucket": bucket, "numbers": array([n for n, _ in strings]), "sizes": array([len(s) for _, s in strings]),
            "low": array([found.low[n] for n, _ in strings]), "high": array([found.high[n] for n, _ in strings]), "data": b"".join(s for _, s in strings),
        } for bucket, strings in out.items()], columns=["part", "bucket", "numbers", "sizes", "low", "high", "data"])

    shape = f"{PART}, {BUCKET}, numbers binary, sizes binary, low binary, high binary, data binary"
    return _both(packed, repeated).groupBy("part").applyInPandas(cut, shape)


def _heavy(strings: DataFrame, name_bytes: int) -> tuple[frozenset[int], int]:
    """Names whose strings have more than ``name_bytes`` in all parts, and some that have half of that, and how many
    shards their windows take.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes)], names=["name", "size"])

    counts = strings.where("bucket = -1").select("numbers", "sizes").mapInArrow(read, "name bigint, size bigint")
    found = counts.groupBy("name").agg(F.sum("size").alias("size")).where(F.col("size") > name_bytes // 2).collect()
    most = LENGTH - GRAM + 1  # windows of a run; their bytes are so many times those of its string
    larger = LENGTH * most / (LENGTH + most - 1)
    return frozenset(r["name"] % (1 << 64) for r in found), -(-int(2 * larger * sum(r["size"] for r in found)) // max(name_bytes, 1))


def _equal_strings(texts: list[bytes], sizes: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """(place of each string among the distinct ones, these)."""
    places: dict[bytes, int] = {}
    own: list[int] = []
    for text, some in zip(texts, sizes):
        ends = np.cumsum(some).tolist()
        own += [places.setdefault(text[a:b], len(places)) for a, b in zip([0, *ends], ends)]
    return np.array(own, np.int64), list(places)


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j from starts[i] to before ends[i]."""
    n = ends - starts
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + starts[i]


def _owners(strings: DataFrame) -> DataFrame:
    """(part, bucket, data): for windows whose owner is before some text of the part, (number, from, to, owner) rows."""
    def order(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda name: [np.frombuffer(bytes(b), np.int64) for b in rows[name]]
        numbers, sizes, low, high = (read(c) for c in ("numbers", "sizes", "low", "high"))
        which = np.repeat(np.arange(len(rows)), [len(n) for n in numbers])
        numbers, lows, highs = (np.concatenate(x) for x in (numbers, low, high))
        own, distinct = _equal_strings([bytes(b) for b in rows["data"]], sizes)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        text = np.frombuffer(b"".join(distinct), np.uint8)
        del distinct
        low, high = np.full(len(sizes), LAST), np.full(len(sizes), -LAST - 1)
        np.minimum.at(low, own, lows)
        np.maximum.at(high, own, highs)
        bounds = np.append(0, np.cumsum(sizes))
        string = np.repeat(np.arange(len(sizes)), sizes)
        owner = np.full(len(text), LAST)
        held: list[np.ndarray] = []
        open_group = -1

        def settle(block: np.ndarray) -> None:
            at, group = block[:, 0], block[:, 1]
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(low[string[at]], cuts)
            owner[at] = np.repeat(least, np.diff(np.append(cuts, len(group))))

        for block in equal_groups(text, bounds, LENGTH):  # a group may go on in the next block
            last = int(block[-1, 1])
            if last != open_group and open_group >= 0:
                held.append(block[block[:, 1] < last])
                settle(np.concatenate(held))
                held = []
            held.append(block[block[:, 1] == last] if last != open_group and open_group >= 0 else block)
            open_group = last
        if held:
            settle(np.concatenate(held))
        place = np.arange(len(text)) - bounds[string]
        window = (bounds[string + 1] - np.arange(len(text)) >= LENGTH) & (owner < high[string])
        at = np.flatnonzero(window)
        starts = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (string[at][1:] != string[at][:-1]) | (owner[at][1:] != owner[at][:-1]))) if len(at) else np.zeros(0, int)
        ends = np.append(starts[1:], len(at)) - 1 if len(at) else starts
        spans = np.stack([place[at[starts]], place[at[ends]] + 1, owner[at[starts]]], axis=1)
        cuts = np.searchsorted(string[at[starts]], np.arange(len(sizes) + 1))
        use, span = _expanded(cuts[own], cuts[own + 1])  # each part's string has the spans of the distinct one
        some = spans[span, 2] < highs[use]
        use, span = use[some], span[some]
        table = np.concatenate([numbers[use][:, None], spans[span]], axis=1)
        part = which[use]
        return pd.DataFrame({
            "part": rows["part"].to_numpy(), "bucket": rows["bucket"].to_numpy(),
            "data": [np.ascontiguousarray(table[part == i]).tobytes() for i in range(len(rows))],
        })

    return strings.where("bucket >= 0").groupBy("bucket").applyInPandas(order, f"{PART}, {BUCKET}, data binary").where("octet_length(data) > 0")


def _cut(packed: DataFrame, uses: DataFrame, owners: DataFrame, keep_text: bool) -> DataFrame:
    """(name, key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every distinct text."""
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda kind: [np.frombuffer(bytes(b), np.int64) for b in rows.loc[rows["kind"] == kind, "data"]]
        use = read(1)[0]
        counts = use[1 : 1 + use[0]]
        numbers, places = use[1 + use[0] :].reshape(2, -1)
        bounds = np.append(0, np.cumsum(counts))
        table = np.concatenate([np.zeros(0, np.int64), *read(2)]).reshape(-1, 4)
        table = table[np.argsort(table[:, 0], kind="stable")]
        out = []
        for t, (key, name, data) in enumerate(_texts(rows[rows["kind"] == 0])):
            change = np.zeros(len(data) + 1, np.int32)
            own, at = numbers[bounds[t] : bounds[t + 1]], places[bounds[t] : bounds[t + 1]]
            i, j = _expanded(np.searchsorted(table[:, 0], own), np.searchsorted(table[:, 0], own, "right"))
            some = table[j, 3] < key
            i, j = i[some], j[some]
            np.add.at(change, at[i] + table[j, 1], 1)
            np.add.at(change, at[i] + table[j, 2] + LENGTH - 1, -1)
            covered = np.cumsum(change[:-1]) > 0
            kept = data[~covered].tobytes()
            spans = int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1))
            out.append((name, key, len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return pd.DataFrame(out, columns=["name", "least", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    shape = "name binary, least bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return _both(packed, uses, owners).groupBy("part").applyInPandas(cut, shape)


def _name(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def remove_repeats(docs: DataFrame, key: str, text: str, keep_text: bool = False, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row, as of the whole input.

    A null text is empty. Rows with one key do not make each other's bytes repeated; a null key is after all others and
    null keys are one key. Repeated rows stay. Texts of fewer than LENGTH bytes lose nothing. The strings of one name are
    at most ``name_bytes`` in a shard.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(12, -(-size // PART_BYTES))
    one = rows.withColumn("name", _name(F.col("text"))).groupBy("name").agg(F.min("key").alias("key"), F.first("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = pa.array([squeeze.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("key"), batch.column("name"), data], names=["part", "key", "name", "data"])

    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    packed = stored(one.select(part.alias("part"), "key", "name", "text").mapInArrow(pack, f"{PART}, key bigint, name binary, data binary"), "texts")
    repeated = stored(_exchange(packed, parts), "names")
    strings = stored(_strings(packed, repeated, parts, name_bytes), "strings")
    heavy, more = _heavy(strings, name_bytes)
    if heavy:
        strings = stored(_strings(packed, repeated, parts, name_bytes, heavy, more), "strings")
    owners = stored(_owners(strings), "owners")
    cuts = stored(_cut(packed, strings.where("bucket = -2"), owners, keep_text), "cuts")
    named = docs.select(F.col(key).alias("own"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("key"), _name(F.col(text)).alias("name"))
    joined = named.join(cuts, "name")
    copy = (F.col("least") < F.col("key")) & (F.col("n_bytes") >= LENGTH)  # all of it is in the first document with this text
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = [
        F.col("own").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return joined.select(*out, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))

"""Similarity join of word n-gram sets by rare-first prefix filtering.

Elements are ordered from rare to frequent over all documents, ties by hash. Of two sets that reach the similarity, the prefixes of
n - ceil(n * percent / 100) + 1 elements share one: only prefixes are indexed. Elements of one document alone are left
out, they match nothing. A pair that shares a prefix element is dropped where sizes, the places of the shared element (what
follows it cannot suffice) or the counts between fixed pivots of the hash order (how many elements must differ) rule the similarity
out; what is left is confirmed on full sets, once.

Equal sets are one class from the start, and links are only followed to find components: an element's classes are first
compared with a few of them (hubs), round by round until few are linked; pairs in different components are then listed by task.

Frequencies are counted exactly. Documents are packed into parts; a part sends its distinct elements, split by hash
range into buckets, and gets back a rank of one byte for each, so a frequent element is one number per part, not one
row per document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ASCII_SPACE, column_bytes, constants, mixed, slices, stored, tiles, word_hashes
from tidemark.llm.minhash import components

PART = 1 << 20  # bytes of text a part; a longer text is a part of its own
BUCKET = 1 << 22  # elements a bucket, about
PIVOTS = 64
HUBS = 3  # a round
FEW = 20  # a round that links fewer than one in FEW of the open classes is the last
BROADCAST = "64m"
LISTED = 64
WAVES = 4  # parts meet their ranks in so many jobs, which bounds the shuffle files that are there at once
ROWS = 512  # members of elements compared at once
CHUNK = 1 << 15  # rows held at once, or one element
_SALT = constants(2, 31)

PARTS = pa.schema([("part", pa.int64()), ("keys", pa.list_(pa.int64())), ("cls", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
PARTS_SQL = "part bigint, keys array<bigint>, cls array<binary>, sizes array<bigint>, data binary"


def gram_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; a text of fewer words is one, a text without words has none."""
    out: list[np.ndarray] = []
    place = constants(width + 1, 29)
    with np.errstate(over="ignore"):
        for a, b in slices(column):
            words, counts = word_hashes(*column_bytes(column.slice(a, b - a)), ASCII_SPACE)
            rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
            for j in range(width):
                rolled += words[j : len(words) - width + 1 + j] * place[j] if len(rolled) else 0
            rolled = mixed(rolled)
            for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                if n >= width:
                    out.append(np.unique(rolled[end - n : end - width + 1]))
                elif n:
                    out.append(mixed(np.array([(words[end - n : end] * place[:n]).sum() + np.uint64(n) * place[width]], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def _class_name(s: np.ndarray) -> bytes:
    """128 bits that follow from the set."""
    with np.errstate(over="ignore"):
        return np.array([mixed(s).sum(), mixed(s ^ _SALT[0]).sum()], np.uint64).tobytes() if len(s) else b""


def packed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Parts of documents: keys, class names, sizes and, for the first of each class in the part, the sets (``data``).

    A size below zero is that of a set that an earlier document of the part holds.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column("text"), PART):
                sets = gram_sets(batch.column("text").slice(a, b - a), width)
                names = [_class_name(s) for s in sets]
                seen: set[bytes] = set()
                sizes, data = [], []
                for name, s in zip(names, sets):
                    sizes.append(-len(s) if name in seen else len(s))
                    if name not in seen:
                        data.append(s.tobytes())
                        seen.add(name)
                made += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([task << 32 | made], pa.int64()), pa.array([batch.column("key").slice(a, b - a).to_pylist()], PARTS.types[1]),
                    pa.array([names], PARTS.types[2]), pa.array([sizes], PARTS.types[3]), pa.array([b"".join(data)], pa.binary()),
                ], schema=PARTS)

    return rows.mapInArrow(run, PARTS_SQL)


def _split(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, low, times) of each part: its distinct elements in a range of hashes, 32 bits of each that follow the range's."""
    bits = int(buckets).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                values, times = np.unique(np.frombuffer(data.as_py(), np.uint64), return_counts=True)
                cuts = np.searchsorted(values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
                low = (values >> np.uint64(32 - bits)).astype(np.uint32)
                some = [i for i in range(buckets) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int64()),
                    pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([times[cuts[i] : cuts[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary()),
                ], names=["bucket", "part", "low", "times"])

    return parts.select("part", "data").mapInArrow(run, "bucket int, part bigint, low binary, times binary")


def _rank(times: np.ndarray) -> np.ndarray:
    """Counts as one byte that never falls with the count: as they are up to 128, then eight steps for each doubling."""
    more = np.minimum(128 + np.log2(np.maximum(times, 128) / 128) * 8, 255)
    return np.where(times <= 128, times, more).astype(np.uint8)


def _ranks(split: DataFrame) -> DataFrame:
    """(part, bucket, ranks): how frequent each element of a part is over all parts. What a bucket holds is bounded by BUCKET's choice."""

    def run(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("low")]
        times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("times")])
        every, place = np.unique(np.concatenate(low), return_inverse=True)
        ranks = _rank(np.bincount(place, weights=times, minlength=len(every)))[place]
        cuts = np.cumsum([0, *[len(x) for x in low]])
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "ranks": pa.array([ranks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return split.groupBy("bucket").applyInArrow(run, "part bigint, bucket int, ranks binary")


def _prefix(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _postings(parts: DataFrame, ranks: DataFrame, percent: int) -> DataFrame:
    """(element, cls, n, place): the prefix elements of each class that occur in more than one document."""
    least = percent // max(1, 100 - percent)  # smaller sets are similar to equal ones alone
    listed = ranks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("bucket", "ranks"))).alias("ranks"))
    both = parts.join(listed, "part").select("cls", "sizes", "data", F.col("ranks.ranks").alias("ranks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                names, sizes = batch.column("cls")[k].as_py(), batch.column("sizes")[k].as_py()
                values = np.frombuffer(batch.column("data")[k].as_py(), np.uint64)
                every, place = np.unique(values, return_inverse=True)
                rank = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in batch.column("ranks")[k]])[place]
                out: list[tuple[np.ndarray, bytes, int, np.ndarray]] = []
                at = 0
                for name, n in zip(names, sizes):
                    if n <= 0:
                        continue
                    own, r = values[at : at + n], rank[at : at + n]
                    at += n
                    if n < least:
                        continue
                    size = _prefix(n, percent)
                    first = np.argpartition(r, size - 1)[:size] if size < n else np.arange(n)
                    top = r[first].max()  # ties at the prefix's end go by hash, as everywhere
                    first = np.flatnonzero(r <= top)
                    first = first[np.lexsort((own[first], r[first]))][:size]
                    several = np.flatnonzero(r[first] > 1)
                    if len(several):
                        out.append((own[first[several]], name, n, several))
                m = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([o[0] for o in out]).view(np.int64) if out else np.zeros(0, np.int64)),
                    pa.array([o[1] for o, c in zip(out, m) for _ in range(c)], pa.binary()),
                    pa.array(np.repeat(np.array([o[2] for o in out], np.int64), m)),
                    pa.array(np.concatenate([o[3] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64)),
                ], names=["element", "cls", "n", "place"])

    rows = both.mapInArrow(run, "element bigint, cls binary, n bigint, place bigint")
    return rows.groupBy("element", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place"))


def _sets(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, pivots, elements) of the wanted classes, each read from one part. ``pivots``: elements in each of PIVOTS ranges of the hashes."""
    here = parts.select("part", F.explode(F.arrays_zip("cls", "sizes")).alias("d")).where("d.sizes > 0")
    one = here.select("part", F.col("d.cls").alias("cls")).join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("part").alias("part"))
    asked = stored(one.groupBy("part").agg(F.collect_list("cls").alias("asked")), "asked")
    both = parts.join(asked, "part").select("cls", "sizes", "data", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                asked = set(batch.column("asked")[k].as_py())
                values = np.frombuffer(batch.column("data")[k].as_py(), np.uint64)
                found, at = [], 0
                for name, n in zip(batch.column("cls")[k].as_py(), batch.column("sizes")[k].as_py()):
                    if n > 0:
                        if name in asked:
                            own = values[at : at + n]
                            found.append((name, n, np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=PIVOTS).astype(np.int32), own.view(np.int64)))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(
                    (pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["cls", "n", "pivots", "elements"])

    rows = both.mapInArrow(run, "cls binary, n bigint, pivots array<int>, elements array<bigint>")
    return stored(rows, "sets", {"spark.sql.autoBroadcastJoinThreshold": BROADCAST})


def _possible(percent: int) -> Column:
    """Whether classes a and b can be similar, by their sizes, the places of a shared element and their pivots' counts."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    needed = (100 + percent) * F.lit(1).cast("bigint")
    reach = F.least("place_a", "place_b") + 1 + F.least(n_a - F.col("place_a"), n_b - F.col("place_b")) - 1
    differ = F.aggregate(F.zip_with("pivots_a", "pivots_b", lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    common = (n_a + n_b - differ) / 2
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (needed * reach >= percent * (n_a + n_b)) & (needed * common >= percent * (n_a + n_b))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left, right = (sets.select(F.col("cls").alias(c), F.col("elements").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("element", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "n", "place", "pivots", "label")])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def _star(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """Pairs of each element's classes with hubs of it in other components, HUBS of them by hash."""
    out = None
    for k in range(HUBS):
        rank = F.xxhash64("cls", F.lit(seed * HUBS + k))
        hubs = rows.groupBy("element").agg(F.max(F.struct(rank.alias("rank"), *[F.col(c) for c in ("cls", "n", "place", "pivots", "label")])).alias("h"))
        some = _side(rows, "a").join(hubs.select("element", *[F.col(f"h.{c}").alias(f"{c}_b") for c in ("cls", "n", "place", "pivots", "label")]), "element")
        some = some.where((F.col("label_a") != F.col("label_b")) & _possible(percent)).select("cls_a", "cls_b")
        out = some if out is None else out.union(some)
    return _ordered(out)


def _meet(left: pa.Scalar, right: pa.Scalar, element: int) -> bool:
    """Whether the element is the first that two classes share, or that is not known."""
    if not left.is_valid or not right.is_valid:
        return True
    other = right.values.to_numpy()
    here = left.values.to_numpy()
    return here[np.isin(here, other)][0] == element


def _listed(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs of one element's classes in different components that can be similar.

    An element's classes are in one task, in order of size; a class meets those of its size band only, ROWS at a time. A
    pair is listed under its first element alone, but for classes of more than LISTED elements, where it may come again.
    """
    own = rows.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "element"))).alias("own"))
    rows = rows.join(own.where(F.size("own") <= LISTED).select("cls", F.col("own.element").alias("own")), "cls", "left")
    dealt = rows.repartition("element").sortWithinPartitions("element", "n", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            element, n, place = (table.column(c).to_numpy() for c in ("element", "n", "place"))
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            pivots = table.column("pivots").combine_chunks().flatten().to_numpy().reshape(-1, PIVOTS)
            names, own = table.column("cls").combine_chunks(), table.column("own").combine_chunks()
            bounds = np.append(np.flatnonzero(np.append(True, element[1:] != element[:-1])), len(element))
            left, right = [np.zeros(0, int)], [np.zeros(0, int)]
            for rows, cols in tiles(bounds, ROWS):
                if rows != cols and percent * n[cols.start] > 100 * n[rows.stop - 1]:
                    continue  # sizes rise within an element
                x, y = np.nonzero((element[rows][:, None] == element[cols]) & (label[rows][:, None] != label[cols]) & (100 * n[rows][:, None] >= percent * n[cols]))
                x, y = x + rows.start, y + cols.start
                x, y = x[x < y], y[x < y]
                both = n[x] + n[y]
                reach = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
                fits = (100 + percent) * reach >= percent * both
                x, y, both = x[fits], y[fits], both[fits]
                for s in range(0, len(x), 1 << 16):
                    i, j, total = x[s : s + (1 << 16)], y[s : s + (1 << 16)], both[s : s + (1 << 16)]
                    fits = (100 + percent) * (total - np.abs(pivots[i] - pivots[j]).sum(axis=1)) >= 2 * percent * total
                    i, j = i[fits], j[fits]
                    first = np.array([_meet(own[p], own[q], element[p]) for p, q in zip(i.tolist(), j.tolist())], bool)
                    left.append(i[first])
                    right.append(j[first])
                if sum(map(len, left)) > 1 << 18:
                    yield out(names, left, right)
                    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
            yield out(names, left, right)

        def out(names: pa.Array, left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["cls_a", "cls_b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(len(h) for h in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            element = table.column("element").to_numpy()
            begin = int(np.searchsorted(element, element[-1]))  # the element that may go on
            if begin:
                yield from pairs(table.slice(0, begin))
                held = table.slice(begin).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return _ordered(dealt.mapInArrow(run, "cls_a binary, cls_b binary"))


def similar(docs: DataFrame, key: str, text: str, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """((key, cls, n) of every row, (node, label) of the classes that are linked with another one)."""
    parts = stored(packed(docs, key, text, width), "parts")
    rows = parts.select(F.explode(F.arrays_zip("keys", "cls", "sizes")).alias("d")).select(
        F.col("d.keys").alias("key"), F.col("d.cls").alias("cls"), F.abs(F.col("d.sizes")).alias("n"))
    elements = parts.agg(F.sum(F.octet_length("data") / 8).alias("n")).first()["n"] or 0
    buckets = 1 << min(24, max(0, int(elements // BUCKET)).bit_length())
    ranks = stored(_ranks(_split(parts, buckets)), "ranks")
    wave = F.pmod(F.xxhash64("part"), F.lit(WAVES))
    found = [stored(_postings(parts.where(wave == w), ranks.where(wave == w), percent), "found") for w in range(WAVES)]
    postings = functools.reduce(DataFrame.union, found).groupBy("element", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    postings = stored(postings, "postings")
    several = postings.groupBy("element").agg(F.count("*").alias("members")).where("members > 1").select("element")
    shared = stored(postings.join(several, "element"), "shared")
    sets = _sets(parts, shared.select("cls").distinct())
    shared = stored(shared.join(sets.select("cls", "pivots"), "cls"), "shared")
    edges = None
    open_ = shared.withColumn("label", F.col("cls"))
    seed, links, classes = 0, 1, 1
    while links and links * FEW >= classes:
        classes = open_.agg(F.count_distinct("cls")).first()[0]
        found = stored(_linked(_star(open_, seed, percent), sets, percent), "links")
        links, seed = found.count(), seed + 1
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        marked = open_.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed_ = marked.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("element")
        open_ = stored(marked.join(mixed_, "element"), "open")
    rest = stored(_linked(stored(_listed(open_, percent), "pairs"), sets, percent), "rest")
    return rows, components(edges.union(rest))


def join_components(docs: DataFrame, key: str, text: str, width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its n-gram set and the least key that links reach.

    Words are runs without ASCII white space after A-Z are lower-cased; a set holds the distinct n-grams of ``width`` words, of a
    text of fewer words the whole sequence. Sets whose intersection is ``percent`` of the union or more are linked. A null or
    empty text has an empty set and is its own component. Rows with one key keep their own texts. Null keys sort last
    and are a component's id only where no other key is reached. An empty table gives no rows.
    """
    rows, labels = similar(docs, key, text, width, percent)
    labelled = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = stored(labelled.select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "cls")).alias("label")), "labelled")
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("key").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    joined = labelled.join(least.select("label", "component_id"), "label", "left")
    component = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.coalesce("component_id", "key"))
    return joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))

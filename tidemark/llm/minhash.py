"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join, confirmed on full shingle sets.

A set's signature has ``SLOTS`` slots of 16 bits, cut into ``CHUNKS`` chunks. Of two signatures that differ in at most
15 slots, some chunk differs in at most one (pigeonhole): so a chunk is indexed under each choice of three of its four
slots, and every such pair meets under some key. Of sets with similarity 0.80, one pair in a million meets under none.

Texts with the same set are one class from the start. Inside a key no pairs are listed among classes that are known to
be connected. Each key compares its classes with one of them, the one that shares its keys with most others; each part of
a key with one, two or three more chunks in common does so with the first by a hash. Confirmed links give components. Keys
with several components take further hubs by hash, round by round, each against the classes of other components, until a round
links few. What is left, classes of one key in different components, is compared in blocks of bounded size: the classes of the key's largest
component meet the others only. A key costs rows in proportion to its classes unless more than ``BLOCK`` of them are outside that
component. Each pair is compared under its first key alone, and confirmed where
sizes, the signature and a longer one of ``WIDE`` slots of 8 bits allow a link. How many slots of each may differ follows
from the similarity: of sets that just reach it, no more than ``MISSED`` differ in more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ASCII_SPACE, column_bytes, constants, mixed, slices, stored, word_hashes

WIDTH = 5
SLOTS, CHUNKS = 32, 8
PERCENT = 85
MISSED = 1e-5
BLOCK = 4096  # classes that a task compares with as many, some eight million comparisons
STRIPE = 256
HUBS = 3  # a round
FEW = 20  # a round that links fewer than one in FEW of the open classes is the last
TASK_SHINGLES = 1 << 21  # of the classes that one task confirms; a pair of larger sets is a task of its own
BROADCAST = "64m"
WIDE = 256
_PLACE = constants(WIDTH + 1, 11)
_SLOT = constants(SLOTS + WIDE, 13)


def radius(percent: int, slots: int, bits: int) -> int:
    """The least number of slots in which all but ``MISSED`` of the pairs of sets with this similarity differ at most."""
    q = (1 - percent / 100) * (1 - 0.5**bits)
    over = 1.0
    for k in range(slots + 1):
        over -= math.comb(slots, k) * q**k * (1 - q) ** (slots - k)
        if over <= MISSED:
            return k
    return slots


def shingle_hashes(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words is one shingle, one without none."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for a, b in slices(column):
            words, counts = word_hashes(*column_bytes(column.slice(a, b - a)), ASCII_SPACE)
            rolled = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
            for j in range(WIDTH):
                rolled += words[j : len(words) - WIDTH + 1 + j] * _PLACE[j] if len(rolled) else 0
            rolled = mixed(rolled)
            ends = np.cumsum(counts)
            for end, n in zip(ends.tolist(), counts.tolist()):
                if n >= WIDTH:
                    out.append(np.unique(rolled[end - n : end - WIDTH + 1]))
                elif n:
                    out.append(mixed(np.array([(words[end - n : end] * _PLACE[:n]).sum() + np.uint64(n) * _PLACE[WIDTH]], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def _least(values: np.ndarray, at: np.ndarray, slot: int) -> np.ndarray:
    return mixed(np.minimum.reduceat(values * _SLOT[slot] ^ (values >> np.uint64(32)), at))


def _signatures(sets: list[np.ndarray], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(sets, SLOTS) slots of 16 bits and (sets, WIDE) of 8: low bits of the least value under each of as many orders.

    Sets of fewer than ``least`` elements have zeros.
    """
    sizes = np.array([len(s) for s in sets])
    short, wide = np.zeros((len(sets), SLOTS), np.uint16), np.zeros((len(sets), WIDE), np.uint8)
    full = np.flatnonzero(sizes >= least)
    for i in range(0, len(full), 256):
        some = full[i : i + 256]
        values = np.concatenate([sets[j] for j in some])
        at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        with np.errstate(over="ignore"):
            for k in range(SLOTS):
                short[some, k] = _least(values, at, k).astype(np.uint16)
            for k in range(WIDE):
                wide[some, k] = _least(values, at, SLOTS + k).astype(np.uint8)
    return short, wide


_LONGS = pa.list_(pa.int64())
TASK = pa.schema([("task", pa.string()), ("cls", pa.list_(pa.binary())), ("label", pa.binary()), ("pairs", pa.binary())])
SIGNED = pa.schema([("key", pa.int64()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("sig", _LONGS), ("wide", _LONGS)])


def _class_name(s: np.ndarray) -> bytes:
    """128 bits that follow from the set."""
    with np.errstate(over="ignore"):
        return np.array([mixed(s).sum(), mixed(s ^ _SLOT[0]).sum()], np.uint64).tobytes() if len(s) else b""


def signed(docs: DataFrame, key: str, text: str, name: Column | None = None) -> DataFrame:
    """(key, cls, n_shingles, sig, wide[, name]) of every row. Equal sets have equal ``cls``; the empty set's is empty."""
    more = [] if name is None else [name.alias("name")]
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), *more)
    schema = SIGNED if name is None else SIGNED.append(pa.field("name", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                sets = shingle_hashes(batch.column("text").slice(a, b - a))
                short, wide = (x.view(np.int64) for x in _signatures(sets))
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(a, b - a), pa.array([_class_name(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(list(short), _LONGS), pa.array(list(wide), _LONGS),
                    *(batch.column(c).slice(a, b - a) for c in batch.schema.names[2:]),
                ], schema=schema)

    return rows.mapInArrow(run, "key bigint, cls binary, n_shingles bigint, sig array<bigint>, wide array<bigint>" + (", name binary" if more else ""))


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the classes in ``wanted`` (key, cls), each read from one row."""
    wanted = wanted.select(F.col("key").alias("wanted"), "cls")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    rows = rows.join(wanted, F.col("key").eqNullSafe(F.col("wanted"))).select("text", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                sets = shingle_hashes(batch.column("text").slice(a, b - a))
                own = [i for i, s in enumerate(sets) if _class_name(s) == batch.column("cls")[a + i].as_py()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("cls").slice(a, b - a).take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64())),
                ], names=["cls", "shingles"])

    return rows.mapInArrow(run, "cls binary, shingles array<bigint>").dropDuplicates(["cls"])


def _slots_apart(a: Column, b: Column, longs: int, bits: int) -> Column:
    """Slots that differ: the low bit of each lane of ``bits`` gathers the lane's bits, and the low bits are counted."""
    low = sum(1 << lane for lane in range(0, 64, bits))
    total = None
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        shift = bits // 2
        while shift:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift //= 2
        n = F.bit_count(x.bitwiseAND(F.lit(low)))
        total = n if total is None else total + n
    return total


def _possible(percent: int) -> Column:
    """Whether classes a and b can be similar, by size and signature."""
    similar = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return similar & (_slots_apart(F.col("sig_a"), F.col("sig_b"), SLOTS // 4, 16) <= radius(percent, SLOTS, 16))


def _index_keys(sig: Column) -> Column:
    """The keys of a signature: each chunk (one long of four slots) with one of its slots left out."""
    masks = [(1 << 64) - 1 ^ (0xFFFF << 16 * lane) for lane in range(4)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(4 * c + lane), sig[c].bitwiseAND(F.lit(masks[lane]))) for c in range(CHUNKS) for lane in range(4)])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the least node it is connected with.

    Each round takes the least label next to a node and then that label's own label, so paths shorten by half or more.
    """
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name)
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        step = stored(step.join(jump, "to").select("node", F.least("to", "next").alias("label"), "was"), name)
        if not step.where(F.col("label") != F.col("was")).limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


def _sets_of(needed: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, shingles) of the classes in ``needed``, read again from the texts.

    Up to ``BROADCAST`` bytes of these, by Spark's estimate, the texts stay where they are; beyond it they are joined by
    a shuffle.
    """
    wanted = stored(needed.join(classes.select("cls", "key"), "cls"), "wanted")
    return stored(_sets(docs, key, text, wanted), "sets", {"spark.sql.autoBroadcastJoinThreshold": BROADCAST})


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    pairs = stored(pairs, "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), classes, docs, key, text)
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _compared(group: dict[str, np.ndarray], percent: int, near_slots: int, near_wide: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one key and one pair of blocks that can be similar and that meet here first."""
    sides = np.unique(group["block"])
    one = np.flatnonzero(group["block"] == sides[0])
    two = one if len(sides) == 1 else np.flatnonzero(group["block"] == sides[1])
    if len(sides) == 1 and group["i"][0] != group["j"][0]:
        return  # the other block is empty
    n, label, sig, wide = (group[c] for c in ("n", "label", "sig", "wide"))
    for start in range(0, len(one), STRIPE):
        some = one[start : start + STRIPE]
        fits = (label[some][:, None] != label[two]) & (np.minimum(n[some][:, None], n[two]) * 100 >= np.maximum(n[some][:, None], n[two]) * percent)
        if one is two:
            fits &= some[:, None] < two
        x, y = (side[i] for side, i in zip((some, two), np.nonzero(fits)))
        for a in range(0, len(x), 1 << 14):
            left, right = x[a : a + (1 << 14)], y[a : a + (1 << 14)]
            same = sig[left] == sig[right]
            near = same.sum(axis=1) >= SLOTS - near_slots
            left, right, same = left[near], right[near], same[near].reshape(-1, CHUNKS, 4)
            shared = (same.sum(axis=2, keepdims=True) - same == 3).reshape(-1, SLOTS)  # a key leaves one slot of a chunk out
            here = shared.argmax(axis=1) == group["k"][0]
            left, right = left[here], right[here]
            near = (wide[left] != wide[right]).sum(axis=1) <= near_wide
            yield from zip(left[near].tolist(), right[near].tolist())


def _batches(pairs: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs in groups whose classes have at most TASK_SHINGLES elements, or one pair."""
    used: set[int] = set()
    start = held = 0
    for i, (x, y) in enumerate(pairs.tolist()):
        more = sum(int(n[c]) for c in (x, y) if c not in used)
        if used and held + more > TASK_SHINGLES:
            yield pairs[start:i]
            used, start, held, more = set(), i, 0, int(n[x] + n[y])
        used |= {x, y}
        held += more
    if len(pairs):
        yield pairs[start:]


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of each key (place, k, cls, label, n, sig, wide) dealt to pairs (i, j) of blocks of about BLOCK classes.

    A key of BLOCK classes is one block. Otherwise classes outside the key's largest component are in the first blocks and
    meet all; those of the largest one are in the blocks after these, and meet the first blocks alone.
    """
    sizes = rows.groupBy("place", "label").agg(F.count("*").alias("members"))
    keys = sizes.groupBy("place").agg(F.max(F.struct("members", "label")).alias("main"), F.sum("members").alias("members"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("bigint")
    small = F.col("members") <= BLOCK  # all of it is one block
    few = F.when(small, 1).otherwise(blocks(F.col("members") - F.col("main.members")))
    many = F.when(small, 0).otherwise(blocks(F.col("main.members")))
    keys = stored(keys.select("place", F.col("main.label").alias("main"), few.alias("few"), many.alias("many")), "open_keys")
    rows, here = rows.join(keys, "place"), F.xxhash64("cls", F.lit(5))
    inside = (F.col("label") == F.col("main")) & (F.col("many") > 0)
    rows = rows.withColumn("block", F.when(inside, F.col("few") + F.pmod(here, "many")).otherwise(F.pmod(here, "few")))
    last = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return rows.withColumn("pair", F.explode(others)).select("place", "k", "pair.i", "pair.j", "block", "cls", "label", "n", "sig", "wide")


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(task, cls, pairs) for classes of one key in different components that can be similar, each pair in one task.

    ``pairs`` numbers the task's classes ``cls``; ``label`` has their components, numbered.
    """
    limits = (percent, radius(percent, SLOTS, 16), radius(percent, WIDE, 8))
    dealt = _dealt(rows)
    dealt = dealt.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            numbers = {c: table.column(c).to_numpy() for c in ("place", "i", "j", "block", "k", "n")}
            longs = {c: table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("sig", "wide")}
            numbers |= {"sig": longs["sig"].view(np.uint16), "wide": longs["wide"].view(np.uint8)}
            numbers["label"] = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            change = np.zeros(table.num_rows, bool)
            for c in ("place", "i", "j"):
                change[1:] |= numbers[c][1:] != numbers[c][:-1]
            cuts = np.append(np.append(0, np.flatnonzero(change)), table.num_rows)
            cls, out = table.column("cls").to_pylist(), []
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                found = np.array(list(_compared({c: v[start:end] for c, v in numbers.items()}, *limits)), np.int32).reshape(-1, 2)
                for number, some in enumerate(_batches(found, numbers["n"][start:end])):
                    used, place = np.unique(some, return_inverse=True)
                    task = ":".join([*(str(numbers[c][start]) for c in ("place", "i", "j")), str(number)])
                    labels = np.unique(numbers["label"][start + used], return_inverse=True)[1]
                    out.append((task, [cls[start + u] for u in used], labels.astype(np.int32).tobytes(), place.astype(np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(TASK.types)], schema=TASK)

        for batch in batches:
            if not len(batch):
                continue
            held.append(pa.Table.from_batches([batch]))
            whole = pa.concat_tables(held)
            last = np.ones(whole.num_rows, bool)
            for c in ("place", "i", "j"):
                values = whole.column(c).to_numpy()
                last &= values == values[-1]
            begin = int(np.flatnonzero(last)[0])  # the group that may go on
            if begin:
                yield pairs(whole.slice(0, begin))
            held = [whole.slice(begin)]
        if held:
            yield pairs(pa.concat_tables(held))

    return dealt.mapInArrow(compare, "task string, cls array<binary>, label binary, pairs binary")


def _linked_in_tasks(tasks: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(a, b): links that connect what the pairs of each task connect. A pair already connected in its task is passed over.

    A task gets the sets of its own classes, TASK_SHINGLES of elements at most or one pair.
    """
    tasks = stored(tasks, "tasks")
    needed = tasks.select("task", F.posexplode("cls").alias("place", "cls"))
    sets = _sets_of(needed.select("cls").distinct(), classes, docs, key, text)
    held = needed.join(sets, "cls").groupBy("task").agg(F.sort_array(F.collect_list(F.struct("place", "shingles"))).alias("sets"))
    both = tasks.join(held, "task").select("cls", "label", "pairs", F.col("sets.shingles").alias("sets"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for i in range(len(batch)):
                cls, label, pairs = (batch.column(c)[i].as_py() for c in range(3))
                sets = [np.asarray(s.values, np.int64) for s in batch.column(3)[i]]
                parent = np.frombuffer(label, np.int32).tolist()

                def root(x: int, parent: list[int] = parent) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                own = parent.copy()
                parent[:] = range(max(own) + 1)
                for x, y in np.frombuffer(pairs, np.int32).reshape(-1, 2).tolist():
                    if root(own[x]) != root(own[y]):
                        n = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                            parent[root(own[x])] = root(own[y])
                            links.append((cls[x], cls[y]))
            yield pa.RecordBatch.from_arrays([pa.array([n[i] for n in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(confirm, "a binary, b binary")


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in keep])


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the keys that have several components, with their ``label``."""
    marked = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    several = marked.groupBy("place").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("place")
    return stored(marked.join(several, "place"), "open")


def _hub_pairs(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """(a, b) of each key's classes and its hubs of other components, HUBS by hash, that can be similar."""
    out = None
    for i in range(HUBS):
        rank = F.xxhash64("cls", F.lit(seed * HUBS + i + 11))
        hubs = rows.groupBy("place").agg(F.max(F.struct(rank.alias("rank"), "cls", "label", "n", "sig")).alias("hub"))
        some = _side(rows.select("place", "cls", "label", "n", "sig"), "a", "place").join(
            hubs.select("place", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("cls", "label", "n", "sig")]), "place")
        some = some.where((F.col("label_a") != F.col("label_b")) & _possible(percent)).select("cls_a", "cls_b")
        out = some if out is None else out.union(some)
    return out.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def link(docs: DataFrame, key: str, text: str, percent: int = PERCENT, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, n_shingles, cls[, name]) of every row, (node, label) of the classes that are linked with another one).

    Linked are sets whose intersection is ``percent`` of the union or more.
    """
    rows = stored(signed(docs, key, text, name), "signed")
    # A set differs from a similar one by a shingle at least, so smaller sets than this are similar to equal ones alone.
    least = -(-percent // (100 - percent))
    classes = rows.where(F.col("n_shingles") >= least).groupBy("cls").agg(
        F.min("key").alias("key"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.min("wide").alias("wide"))
    classes = stored(classes, "classes")
    sized = classes.select("cls", "n", "sig")
    keyed = classes.select("cls", F.posexplode(_index_keys(F.col("sig"))).alias("k", "place"))
    several = keyed.groupBy("place").agg(F.count("*").alias("members")).where("members > 1")
    keyed = stored(keyed.join(several, "place"), "keyed")
    central = keyed.groupBy("cls").agg(F.sum("members").alias("central"))
    ranked = stored(keyed.join(central, "cls").join(classes.select("cls", "sig"), "cls"), "ranked")
    more = [F.element_at("sig", ((F.floor(F.col("k") / 4) + i) % CHUNKS + 1).cast("int")) for i in (1, 2, 3)]
    star = None
    for level in range(4):
        rank = F.col("central") if not level else F.xxhash64("cls", F.lit(level))
        at = ranked.select("cls", rank.alias("rank"), F.xxhash64("place", *more[:level]).alias("at"))
        hubs = at.groupBy("at").agg(F.max(F.struct("rank", "cls"))["cls"].alias("hub"))
        some = at.join(hubs, "at").where(F.col("cls") != F.col("hub")).select(F.least("cls", "hub").alias("cls_a"), F.greatest("cls", "hub").alias("cls_b"))
        star = some if star is None else star.union(some)
    star = star.distinct().join(_side(sized, "a"), "cls_a").join(_side(sized, "b"), "cls_b").where(_possible(percent))
    edges = stored(_linked(star.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), classes, docs, key, text, percent), "edges")
    labels = components(edges)
    # A key of two classes has been settled by its hub.
    open_ = _open(keyed.where("members > 2").select("place", "k", "cls").join(sized, "cls"), labels)
    seed, links, open_classes = 0, 1, 1
    while links and links * FEW >= open_classes:
        open_classes = open_.agg(F.count_distinct("cls")).first()[0]
        found = stored(_linked(_hub_pairs(open_, seed, percent), classes, docs, key, text, percent), "links")
        links, seed = found.count(), seed + 1
        if links:
            edges = edges.union(found)
            labels = components(edges)
            open_ = _open(open_.drop("label"), labels)
    rest = _block_pairs(open_.join(classes.select("cls", "wide"), "cls"), percent)
    rest = stored(_linked_in_tasks(rest, classes, docs, key, text, percent), "rest")
    if rest.limit(1).count():
        labels = components(edges.union(rest))
    return rows.drop("sig", "wide"), labels


def near_duplicates(docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: the least key that links reach, and whether it is the row's own.

    Words are runs without ASCII white space after A-Z are lower-cased; sets whose intersection is ``percent`` of the
    union or more are linked. A null or empty text has an empty set and is its own component. Rows with one key keep their own
    texts; a key is kept in each of its rows. Null keys sort last and are kept only where no other key is reached.
    """
    rows, labels = link(docs, key, text, percent)
    labelled = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    labelled = stored(labelled.select("key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "cls")).alias("label")), "labelled")
    least = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("key").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    joined = labelled.join(least.select("label", "component_id"), "label", "left")
    component = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.coalesce("component_id", "key"))
    return joined.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of linked texts one row stays.

    It is that with the least key, null keys being last, then with the least SHA-256 of the text, then one of those with
    this key and text. A null or empty text is in no group and stays. Rows are told apart by key and text, so a key that
    repeats or is null loses only the rows that are in a group.
    """
    name = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows, labels = link(docs, key, text, percent, name)
    rows = rows.where("n_shingles > 0").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rows = stored(rows.select("key", "name", F.coalesce("label", "cls").alias("label")), "labelled")
    order = F.struct(F.col("key").isNull().alias("last"), "key", "name")
    first = rows.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("members")).where("members > 1")
    stays = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("name") == F.col("first.name"))
    marks = rows.join(first, "label").groupBy(F.col("key").alias("gone"), F.col("name").alias("gone_name")).agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    marks = stored(marks.where("NOT stays OR n > 1"), "marks")
    here = docs[key].cast("bigint").eqNullSafe(marks["gone"]) & (F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)) == marks["gone_name"])
    kept = docs.join(marks, here, "left_anti")
    if marks.where("stays").limit(1).count():
        kept = kept.union(docs.join(marks, here & marks["stays"], "left_semi").dropDuplicates([key, text]))
    return kept

"""Hard negatives by slot-decomposed selection.

A positive with score p admits negatives whose score lies between a lower and an upper share of p. For one anchor the
upper limits of its positives cut the scores into disjoint slots. Each task keeps the first ``keep`` negatives of each slot for the
blocks it scores, Spark ranks these again within (anchor, slot), and merging the slots from a positive's limit downwards
gives the first ``keep`` below that limit, of which those above the lower limit are the answer. No negative is held twice
for overlapping windows.

Rows are packed into blocks where they lie. A block of rows meets all blocks of anchors of its dimension through an equi-join on
a group of row blocks: rows move once, anchors once per group. Scores are matrix products, in the narrowest type that
holds them exactly. What an anchor keeps per block is bounded, and nothing is grouped by label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored

ROWS = 16384  # rows a block
ANCHORS = 4096  # anchors a block
CELLS = 1 << 21  # scores held at once
GROUPS = 1024  # groups of row blocks at most; anchors move once per group
NO_ID = np.iinfo(np.int64).max  # stands for a null id, so that it comes last
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("data", pa.binary())])
BLOCK_SQL = "block bigint, dim int, n int, kind string, ids binary, labels binary, data binary"


def _whole(vectors: np.ndarray, scale: float) -> tuple[np.ndarray, str]:
    """floor(scale * x) in the narrowest kind: i2, i4, f8 (whole doubles), or O (beyond 2**53, as doubles too)."""
    x = np.floor(scale * vectors.astype(np.float64))
    top = float(np.abs(x).max(initial=0.0))
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return x.astype(kind), kind


def packed(rows: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows (id bigint, label bigint, vec), each of one dimension and in order of id.

    Rows with a null label, a null vector or a component that is null or not finite take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(ids, kind="stable")
            data, kind = _whole(vectors[order], scale)
            made += 1
            values = [part << 32 | made, dim, len(ids), kind, ids[order].tobytes(), labels[order].tobytes(), data.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK.types)], schema=BLOCK)

        for batch in batches:
            ids = batch.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column("vec")
            offsets = vectors.offsets.to_numpy()
            flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = flat[offsets[own][:, None] + np.arange(dim)] if dim else np.zeros((len(own), 0))
                good = np.isfinite(x).all(axis=1)
                own, x = own[good], x[good]
                at = 0
                while at < len(own):
                    take = size - sum(len(h[0]) for h in held.setdefault(dim, []))
                    some = own[at : at + take]
                    held[dim].append((ids[some], labels[some], x[at : at + take]))
                    at += take
                    if at <= len(own):
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    rows = rows.where("label IS NOT NULL AND vec IS NOT NULL")
    return rows.mapInArrow(run, BLOCK_SQL)


def _matrix(n: int, dim: int, kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dim)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; beyond these they stay at the end of the range."""
    if not rows.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    left, right = (np.array([[int(x) for x in r] for r in m], object) for m in (anchors, rows))
    return np.clip(left @ right.T, LOW, HIGH).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` of each group, by falling score and then by place."""
    order = np.lexsort((place, -1 - score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < keep]


def _cells(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of rows beside each block of anchors of its dimension."""
    blocks = rows.count()
    groups = min(max(blocks, 1), GROUPS)
    right = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left = rows.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"), "dim", *[F.col(c).alias(f"r_{c}") for c in ("n", "kind", "ids", "labels", "data")])
    return left.join(right, ["grp", "dim"])


def _select(cells: DataFrame, choose: Callable[..., tuple[np.ndarray, ...]], keep: int, extra: list[str]) -> DataFrame:
    """(block, i, anchor, slot, score, id): in each cell the first ``keep`` of each (anchor, slot) that ``choose`` finds."""
    names = ["block", "n", "kind", "ids", "labels", "data", "dim", "r_n", "r_kind", "r_ids", "r_labels", "r_data", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = {c: batch.column(c)[k].as_py() for c in names}
                left, right = _matrix(r["n"], r["dim"], r["kind"], r["data"]), _matrix(r["r_n"], r["dim"], r["r_kind"], r["r_data"])
                ids, labels, r_ids, r_labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "r_ids", "r_labels"))
                step = max(1, CELLS // max(1, r["r_n"]))
                for a in range(0, r["n"], step):
                    part = slice(a, a + step)
                    scores = _scores(left[part], right)
                    at, slot, place = choose(scores, ids[part], labels[part], r_ids, r_labels, *[r[c][part] for c in extra])
                    best = _first(at * (1 << 16) + slot, scores[at, place], place, keep)
                    at, slot, place = at[best], slot[best], place[best]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), r["block"])), pa.array((at + a).astype(np.int32)), pa.array(ids[part][at]),
                        pa.array(slot.astype(np.int32)), pa.array(scores[at, place]), pa.array(r_ids[place]),
                    ], names=["block", "i", "anchor", "slot", "score", "id"])

    return cells.select(*names).mapInArrow(run, "block bigint, i int, anchor bigint, slot int, score bigint, id bigint")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of each (anchor, slot) over all cells; Spark cuts each task's rows to these before the shuffle."""
    order = Window.partitionBy("block", "i", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _positives(keep: int) -> Callable[..., tuple[np.ndarray, ...]]:
    def choose(scores, ids, labels, r_ids, r_labels):
        fits = (labels[:, None] == r_labels) & (ids[:, None] != r_ids)
        if scores.shape[1] > keep and scores.size:  # what is below the keep-th of its row cannot be among the first
            floor = np.partition(np.where(fits, scores, LOW), scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            fits &= scores >= floor[:, None]
        at, place = np.nonzero(fits)
        return at, np.zeros(len(at), np.int64), place

    return choose


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(low: int, high: int) -> Callable[..., tuple[np.ndarray, ...]]:
    def choose(scores, ids, labels, r_ids, r_labels, positives):
        ats, slots, places = [], [], []
        for a, own in enumerate(positives):
            limits = [_limits(p, low, high) for p in own]
            uppers = sorted({b for _, b in limits}, reverse=True)
            least = min((x for x, _ in limits), default=0)
            if uppers:
                place = np.flatnonzero((labels[a] != r_labels) & (scores[a] <= uppers[0]) & (scores[a] >= least))
                ats.append(np.full(len(place), a))
                places.append(place)
                slots.append(len(uppers) - 1 - np.searchsorted(uppers[::-1], scores[a, place]))  # the least limit that is not exceeded
        if not ats:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(ats), np.concatenate(slots), np.concatenate(places)

    return choose


def mine(rows: DataFrame, anchors: Column, key: str = "id", label: str = "label", vector: str = "vec", scale: float = 256.0,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's hard negatives.

    Anchors are the rows where ``anchors`` holds. A score is the inner product of floor(scale * x). Each anchor's
    ``positives`` are the first rows of its label with another id, by falling score and then by id; for each, the first ``negatives``
    rows of other labels with low * p <= 100 * n <= high * p are given, ranked from 1. A negative p admits none.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Only vectors of one
    length have a score. Null keys come last among ties and take part; the greatest 64-bit key stands for them inside, so
    it must not be used. Repeated rows are rows of their own, but not positives of one another's keys. Scores beyond 64
    bits stay at the end of that range. An empty table, or one without anchors, gives no rows.
    """
    plain = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vec"), anchors.alias("chosen"))
    blocks = stored(packed(plain.drop("chosen"), scale, ROWS), "vectors")
    chosen = plain.where("chosen").drop("chosen")
    parts = -(-chosen.count() // ANCHORS)
    own = stored(packed(chosen.repartition(max(parts, 1)), scale, ANCHORS), "anchors")
    near = stored(_ranked(_select(_cells(blocks, own), _positives(positives), positives, []), positives), "positives")

    per_anchor = near.groupBy("block", "i").agg(F.collect_list("score").alias("scores"))
    listed = per_anchor.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", "scores"))).alias("by"))
    filled = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.col("by")[i], F.array().cast("array<bigint>")))
    limited = own.join(listed, "block").withColumn("positives", filled).drop("by")
    found = _ranked(_select(_cells(blocks, limited), _negatives(low, high), negatives, ["positives"]), negatives)

    # Slots fall from 0 on, so the rows from a positive's slot on, in order, are its merged suffix.
    entry = F.struct((-F.col("slot")).alias("slot"), F.col("score"), (-1 - F.col("id")).alias("id"))
    merged = found.groupBy("block", "i").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("slots"))
    upper = F.expr(f"floor(CAST(score AS DECIMAL(20, 0)) * {high} / 100)")
    with_slot = near.withColumn("own", F.dense_rank().over(Window.partitionBy("block", "i").orderBy(upper.desc())) - 1)
    each = with_slot.join(merged, ["block", "i"]).select(
        "anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"),
        F.slice(F.filter("slots", lambda s: -s["slot"] >= F.col("own")), 1, negatives).alias("merged"))
    big = lambda c: c.cast("decimal(20,0)")
    fits = F.filter("merged", lambda s: big(F.col("positive_score")) * low <= big(s["score"]) * 100)
    out = each.select("anchor", "positive", "positive_score", F.posexplode(fits).alias("rank", "n"))
    real = lambda c: F.when(c != int(NO_ID), c)
    return out.select(
        F.col("anchor").alias("anchor_id"), real(F.col("positive")).alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"),
        real(-1 - F.col("n.id")).alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))

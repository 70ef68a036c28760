"""Spelling variants by blocked Gram matrices of letter counts.

One inserted or deleted letter changes one letter count by one, one replaced letter changes two: near words have letter counts at
a squared distance of at most two, and lengths that differ by at most one. Squared distances of a block of words come
from one matrix product (the Gram matrix). Comparing all words of adjacent lengths would grow with the square of the
vocabulary, so blocks are narrower: a word is cut into quarters, one edit leaves three of them as they are, and a block holds the words of
length L and L + 1 that agree in three quarters (their places counted from the side they are on, their lengths from L). Pairs
at a distance of two or less are verified as edits. Words of one block differ in a few letters, which bounds its size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import stored, tiles

TILE = 256  # words a matrix product
CHUNK = 1 << 15  # rows held at once, or one block
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_COLUMN = np.full(0x100, -1)
_COLUMN[LETTERS] = np.arange(len(LETTERS))


def noted(key: str, run: str, every: int) -> str:
    """The run as it is read: where ``every`` divides the checksum of key and run, one code point is left out."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def vocabulary(docs: DataFrame, key: str, text: str, least: int = 7, occurrences: int = 2, every: int = 0) -> DataFrame:
    """(word, n): the words of ``least`` code points or more that occur ``occurrences`` times or more, over whole texts.

    A task counts what it reads before anything moves. ``every`` other than 0 leaves letters out as ``noted`` does.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text")):
                own: Counter = Counter()
                for word, n in Counter(RUN.findall(body.as_py())).items():
                    if len(word) >= least:
                        own[word.translate(LOWER)] += n
                for word, n in own.items():
                    word = noted(name or "", word, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) > 1 << 19:
                    yield counted()
        yield counted()

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _ends(length: Column) -> list[tuple[Column, Column]]:
    """(first, last): the letters that a pair agrees in at both sides, by where its edit is; one of the four fits any edit."""
    half = F.floor(length / 2).cast("int")
    rest = (length - half).cast("int")
    near, far = F.floor(rest / 2).cast("int"), F.floor(half / 2).cast("int")
    none = F.lit(0)
    return [(half + near, none), (half, rest - near), (far, rest), (none, rest + half - far)]


def _first(word: str, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _last(word: str, n: Column) -> Column:
    return F.substring(word, F.char_length(word) - n + 1, n)


def _keyed(words: DataFrame) -> DataFrame:
    """(block, kind, short, word, n): each word in the blocks of its own length and of the length below."""
    def keys(length: Column, short: bool) -> list[Column]:
        named = [F.concat_ws(":", length.cast("string"), F.lit(str(k)), _first("word", a), _last("word", b)) for k, (a, b) in enumerate(_ends(length))]
        return [F.struct(name.alias("block"), F.lit(k).alias("kind"), F.lit(short).alias("short")) for k, name in enumerate(named)]

    n = F.char_length("word")
    return words.select(F.explode(F.array(*keys(n, True), *keys(n - 1, False))).alias("k"), "word", "n").select("k.*", "word", "n")


def _counts(words: np.ndarray) -> np.ndarray:
    """Letter counts of words, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(at * len(LETTERS) + _COLUMN[codes], minlength=len(words) * len(LETTERS)).reshape(-1, len(LETTERS)).astype(np.float32)


def _near(word: np.ndarray, block: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the pairs of one block whose letter counts are at most two apart; x is short, so not the longer."""
    counts = _counts(word)
    size = (counts * counts).sum(axis=1)
    starts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
    xs, ys = [np.zeros(0, int)], [np.zeros(0, int)]
    for rows, cols in tiles(starts, TILE):
        apart = size[rows][:, None] + size[cols] - 2 * (counts[rows] @ counts[cols].T)
        x, y = np.nonzero((apart <= 2) & (block[rows][:, None] == block[cols]))
        x, y = x + rows.start, y + cols.start
        once = (x < y) & (short[x] | short[y])
        x, y = x[once], y[once]
        xs.append(np.where(short[x], x, y))
        ys.append(np.where(short[x], y, x))
    return np.concatenate(xs), np.concatenate(ys)


def close_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words that differ by one inserted, deleted or replaced code point, each pair once."""
    dealt = _keyed(words).repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            word, n, kind, short = (table.column(c).to_numpy(zero_copy_only=False) for c in ("word", "n", "kind", "short"))
            x, y = _near(word, table.column("block").combine_chunks().dictionary_encode().indices.to_numpy(), short)
            return pa.RecordBatch.from_arrays([
                pa.array(kind[x], pa.int32()), pa.array(word[x], pa.string()), pa.array(n[x], pa.int64()), pa.array(word[y], pa.string()), pa.array(n[y], pa.int64()),
            ], names=["kind", "a", "n_a", "b", "n_b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(len(h) for h in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            begin = pc.index(table.column("block"), table.column("block")[-1]).as_py()  # the block that may go on
            if begin:
                yield pairs(table.slice(0, begin))
                held = table.slice(begin).to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "kind int, a string, n_a bigint, b string, n_b bigint")
    # A pair that agrees in several ways is taken where it does so first.
    earlier = F.lit(False)
    for k, (first, last) in enumerate(_ends(F.char_length("a"))[:-1]):
        earlier |= (F.col("kind") > k) & (_first("a", first) == _first("b", first)) & (_last("a", last) == _last("b", last))
    return found.where((F.levenshtein("a", "b", 1) == 1) & ~earlier).drop("kind")


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) where each word's form is followed to the last one; paths halve with each round."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not on.where("moved").limit(1).count():
            return on.select("word", "root")
        steps = on.select("word", "root")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word in (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word
    of the largest n, the least in code-point order of several, if that n is at least ``factor`` times the word's own. The
    root is where following forms ends, the word itself if it has none. Words must be distinct; an empty table gives no rows.
    """
    words = stored(words, "words")
    pairs = stored(close_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("n_a")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("falling"), "near")).alias("first"))
    of = F.when(-F.col("first.falling") >= F.col("n") * factor, F.col("first"))
    named = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), of["near"].alias("form"), (-of["falling"]).alias("form_n")), "forms")
    roots = _followed(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

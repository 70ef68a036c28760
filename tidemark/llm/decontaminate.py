"""Benchmark decontamination: a hash set of the test items' word windows is checked at every word of every text.

A window is ``n`` consecutive words of an item, or the whole item if it has fewer. The set travels with the plan, as a
literal, up to ``set_limit`` windows; beyond it the windows of the texts are joined with those of the items. Both ways
find the same hits, and hits are verified on the words themselves. Everything is SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words of lower-cased text
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; texts of one-byte characters take the cheaper function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), GAP), "")


def item_windows(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(window, size, item): each item's distinct windows as arrays of words. Items without words have none."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    each = words.select("item", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
    return each.distinct()


def rarest(window: Column) -> Column:
    """The longest word of a window, of equally long ones the last in order: long words are rare in texts."""
    return F.array_max(F.transform(window, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]


@dataclass(frozen=True)
class WindowSet:
    """The windows of one size: their hashes, and words of which each window has one."""

    size: int
    hashes: list[int]
    anchors: list[str]


def _windows_at(words: Column, sizes: list[int], known: dict[int, WindowSet] | None) -> Column:
    """(start, size, hash, window) of the text's windows; with ``known`` those whose hash is among them.

    Then only windows that hold one of the anchors are hashed, which loses none.
    """
    def of(size: int) -> Column:
        last = F.size(words) - size
        if known is None:
            starts = F.when(last >= 0, F.sequence(F.lit(0), last))
        else:
            at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(known[size].anchors), i)))
            ranges = F.transform(at, lambda i: F.when((last >= 0) & (i - (size - 1) <= last), F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.least(i, last))))
            starts = F.array_distinct(F.flatten(F.array_compact(ranges)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash")))
        found = hashed if known is None else F.filter(hashed, lambda w: w["hash"].isin(known[size].hashes))
        return F.transform(found, lambda w: F.struct(w["start"].alias("start"), F.lit(size).alias("size"), w["hash"].alias("hash"), F.slice(words, w["start"] + 1, size).alias("window")))

    return F.concat(*map(of, sizes)) if sizes else F.array().cast("array<struct<start:int,size:int,hash:bigint,window:array<string>>>")


def mark_hits(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 10, set_limit: int = 200_000) -> DataFrame:
    """One row per document row: its key, ``n_words``, ``hits`` (start, end of word runs inside windows) and ``items``.

    Null and empty texts have no words. Rows with equal key and text have equal results. Item ids are strings, sorted.
    Nulls among item ids are left out of ``items``, but what such an item covers is hit.
    """
    windows = stored(item_windows(items, item, item_text, n).withColumn("hash", F.xxhash64("window")), "windows")
    sets = windows.select("size", "hash", rarest(F.col("window")).alias("anchor")).distinct()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most n
    keys: dict[int, WindowSet] | None = None
    if sets.count() <= set_limit:
        rows = sets.collect()
        keys = {n: WindowSet(n, [r["hash"] for r in rows if r["size"] == n], sorted({r["anchor"] for r in rows if r["size"] == n})) for n in sizes}
    # The words are bound to a lambda's variable: a column of their own would be computed again at each use.
    look = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(F.size(w).alias("n"), _windows_at(w, sizes, keys).alias("found")))[0]
    content = F.xxhash64(F.col(text)).alias("content")
    if keys is not None:
        seen = docs.select(F.col(key).alias("key"), content, look.alias("w"))
        seen = stored(seen.select("key", "content", F.col("w.n").cast("bigint").alias("n_words"), F.col("w.found").alias("found")), "windows")
        base, near = seen.select("key", "content", "n_words"), seen.select("key", "content", F.explode("found").alias("w"))
    else:
        base = docs.select(F.col(key).alias("key"), content, F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
        near = docs.select(F.col(key).alias("key"), content, F.explode(look["found"]).alias("w"))
    near = near.select("key", "content", "w.*")
    none = F.array().cast("array<struct<start:int,end:int>>")
    verified = near.join(windows.select("size", "hash", "window", "item"), ["size", "hash", "window"])
    verified = stored(verified.select("key", "content", "start", (F.col("start") + F.col("size")).alias("end"), "item").distinct(), "hits")
    by_row = ["key", "content"]
    ahead = Window.partitionBy(*by_row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = verified.select(*by_row, "start", "end").distinct().withColumn("reach", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    spans = spans.where(F.col("end") > F.col("reach")).withColumn("start", F.greatest("start", "reach"))
    hits = spans.groupBy(*by_row).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))
    named = verified.select(*by_row, F.col("item").cast("string").alias("item")).distinct()
    named = named.groupBy(*by_row).agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = hits.join(named, (hits.key.eqNullSafe(named.key)) & (hits.content == named.content)).select(hits.key, hits.content, "hits", "items")
    joined = base.join(marks, base.key.eqNullSafe(marks.key) & (base.content == marks.content), "left")
    return joined.select(base.key, base.content, "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(marked: DataFrame, key: str) -> DataFrame:
    """The digest of ``mark_hits``: words, words hit, items and whether the row is contaminated."""
    n_hit = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"]).cast("bigint")
    return marked.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int = 10, drop_share: float = 0.5) -> DataFrame:
    """The documents without benchmark passages, columns and untouched rows as they were.

    A document loses the words that are hit, with what stands between them and behind the run up to the next word; one
    whose words are hit for ``drop_share`` or more is dropped. Null texts stay.
    """
    marked = stored(mark_hits(docs, key, text, items, item, item_text, n).where(F.size("hits") > 0), "marked")
    n_hit = F.aggregate("hits", F.lit(0), lambda a, h: a + h["end"] - h["start"])
    marked = marked.select("key", "content", "hits", (n_hit >= F.col("n_words") * drop_share).alias("drop")).distinct()
    joined = docs.join(marked, docs[key].eqNullSafe(marked["key"]) & (F.xxhash64(docs[text]) == marked["content"]), "left")
    joined = joined.where(~F.coalesce(marked["drop"], F.lit(False)))
    whole, hits = docs[text], marked["hits"]
    pieces = F.split(whole, f"(?<!{IN_WORD})(?={IN_WORD})")  # each word with what follows, after what stands before the first
    lead = F.when(whole.rlike(rf"\A{IN_WORD}"), 0).otherwise(1)
    bound = F.array(F.struct(lead.alias("lead"), pieces.alias("pieces")))  # computed once a text, not once a word

    def without_hits(parts: Column) -> Column:
        outside = F.filter(parts["pieces"], lambda p, i: ~F.exists(hits, lambda h: (i - parts["lead"] >= h["start"]) & (i - parts["lead"] < h["end"])))
        return F.array_join(outside, "")

    cut = F.when(hits.isNotNull(), F.transform(bound, without_hits)[0]).otherwise(whole)
    return joined.select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])

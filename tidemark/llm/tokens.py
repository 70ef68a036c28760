"""Token counts by whole tokens: words that are one token are counted as they stand, only the rest is merged.

Which strings of the vocabulary encode alone as one token is proved with the library before any text is read. The
split into words is the library's own where a text has characters outside Latin-1, and an equal pattern elsewhere.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import slices

CACHE = 400_000
# Fixed value: the vocabulary's split for characters up to U+00FF, after lower-casing.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_WIDE = re.compile(r"[^\x00-\xff]")


def vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class TokenCounter:
    """Counts of one worker; ``cost`` holds proven words (1) and the words merged so far, at most CACHE of them."""

    def __init__(self, path: str):
        self.library = vocabulary(path)
        self.normalizer, self.splitter, self.model = self.library.normalizer, self.library.pre_tokenizer, self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = dict.fromkeys(self._proved(), 1)
        self.cost: dict[str, int] = {}

    def _proved(self) -> list[str]:
        """Words w such that w with a word end is in the vocabulary and the library encodes w as that one token."""
        ends = [t[:-4] for t in self.library.get_vocab(with_added_tokens=False) if t.endswith("</w>")]
        plain = [w for w in ends if w.isascii() and w.isprintable() and _LATIN.fullmatch(w)]
        encoded = self.library.encode_batch(plain, add_special_tokens=False)
        return [w for w, e in zip(plain, encoded) if len(e.ids) == 1 and e.tokens[0] == f"{w}</w>"]

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text without special strings in normal form, and the tokens of those without a stable one."""
        if not _WIDE.search(text):  # composed already, and lower() is the library's own rule
            return _LATIN.findall(text.lower()), 0
        text = self.normalizer.normalize_str(text)
        plain, more = [], 0
        for piece, (a, b) in self.splitter.pre_tokenize_str(text):
            word = text[a:b]
            if word.isascii() or self.normalizer.normalize_str(word) == word:
                plain.append(word)
            else:
                more += len(self.model.tokenize(piece))
        return plain, more

    def count(self, texts: list[str]) -> list[int]:
        counted = []
        for text in texts:
            extra, parts = 0, [text]
            if self.marks is not None and "<|" in text:
                parts = self.marks.split(text)
                extra = len(parts) - 1
            found: Counter[str] = Counter()
            for part in parts:
                plain, more = self.words(part)
                found.update(plain)
                extra += more
            counted.append((extra, found))
        words = set().union(*(f for _, f in counted))
        rest = [w for w in words if w not in self.whole and w not in self.cost]
        if len(self.cost) + len(rest) > CACHE:
            self.cost.clear()
            rest = [w for w in words if w not in self.whole]
        if rest:
            encoded = self.library.encode_batch_fast(rest, add_special_tokens=False)
            self.cost.update(zip(rest, (len(e.ids) for e in encoded)))
        whole, cost = self.whole, self.cost
        return [extra + sum(n * (whole.get(w) or cost[w]) for w, n in found.items()) for extra, found in counted]


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, key: str, text: str, path: str, limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, as the library counts the whole text.

    ``path`` is the tokenizer's file, present on every executor. A null text is empty and has no tokens. Special
    strings inside a text are special tokens, the library's default. Repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        counter = _counters[path]
        for batch in batches:
            counts: list[int] = []
            for a, b in slices(batch.column("text")):
                counts += counter.count([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, pa.array(counts, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"key {key_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Toxicity by a learned lexicon: Levenshtein automata run over the lexicon's trie, hits weighed by their context.

Terms are whole words or stems that labelled toxic documents have and others lack. A word is a hit if it is within a
term's distance (0 to 4 letters: 0, 5 to 8: 1, more: 2; stems of under 6 letters: 0). A hit inside quotation marks or
next to a word that reports speech counts as quoted; next to a form of "you" as aimed at someone.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import slices
from tidemark.llm.labels import held_out, training_sample

WORD = re.compile(r"\w+")
STEM_LENGTHS = range(4, 9)
# Marks and words that decide the context of a hit.
QUOTES = re.compile(r"[\"“”„«»‘’]")
REPORTING = frozenset("said says saying quote quoted quotes called wrote sagte sagt schrieb zitat dit écrit citation dijo dice escribió cita".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi ton vous votre usted tú ti tus vosotros".split())
WINDOW = 40
FEATURES = 7


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Node:
    depth: int
    children: dict[str, Node] = field(default_factory=dict)
    terms: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float
    several: float = 0.0  # the weight of two or more different words of a stem

    @property
    def reach(self) -> int:
        n = len(self.text)
        if self.stem:
            return 0 if n < 6 else 1
        return 0 if n < 5 else 1 if n < 9 else 2


class Lexicon:
    """The trie of the terms. ``look`` runs the automata of all words over it at once."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.root = Node(0)
        for i, term in enumerate(terms):
            node = self.root
            for c in term.text:
                node = node.children.setdefault(c, Node(node.depth + 1))
            node.terms.append(i)
        self.reach = max((t.reach for t in terms), default=0)
        self.longest = max((len(t.text) for t in terms), default=0)

    def look(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """(term, distance) of each word that is within a term's distance: the nearest term, then the first.

        A state is a band of the row of edit distances between a word and the path to the node: entry j belongs to the
        word's first depth + j - reach letters. A word goes on to a child only while an entry is within reach.
        """
        k, width = self.reach, self.longest + self.reach
        sizes = np.array([len(w) for w in words])
        letters = np.zeros((len(words), width + 2 * k + 1), "<U1")
        for i, w in enumerate(words):
            cut = w[:width]
            letters[i, : len(cut)] = list(cut)
        found: dict[str, tuple[int, int]] = {}
        band = np.arange(-k, k + 1)
        start = np.where(band >= 0, band, 99)[None, :].repeat(len(words), 0)

        def visit(node: Node, alive: np.ndarray, rows: np.ndarray) -> None:
            for number in node.terms:
                term = self.terms[number]
                place = node.depth + band
                real = (place >= 0) & (place <= sizes[alive][:, None])
                fits = real if term.stem else real & (place == sizes[alive][:, None])
                least = np.where(fits, rows, 99).min(axis=1)
                for i in np.flatnonzero(least <= term.reach):
                    word, now = words[alive[i]], (int(least[i]), number)
                    if word not in found or now < (found[word][1], found[word][0]):
                        found[word] = (number, int(least[i]))
            for c, child in node.children.items():
                place = child.depth + band
                here = np.clip(place - 1, 0, letters.shape[1] - 1)
                same = letters[alive][:, here] == c
                new = rows + np.where(same, 0, 1)  # the diagonal: entry j of the row before
                new = np.minimum(new, np.append(rows[:, 1:], np.full((len(rows), 1), 99), axis=1) + 1)  # a letter of the term left out
                new[:, place < 0] = 99
                new[:, place == 0] = child.depth
                for j in range(1, 2 * k + 1):  # a letter of the word too many
                    new[:, j] = np.minimum(new[:, j], new[:, j - 1] + 1)
                on = new.min(axis=1) <= k
                if on.any():
                    visit(child, alive[on], new[on])

        if words and self.terms:
            visit(self.root, np.arange(len(words)), start)
        return found


def _context(text: str, start: int, end: int) -> str:
    """quoted, aimed or plain, from the marks and words around a hit."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    around = set(WORD.findall(before)) | set(WORD.findall(after))
    if QUOTES.search(before.split("\n")[-1]) and QUOTES.search(after.split("\n")[0]) or around & REPORTING:
        return "quoted"
    return "aimed" if around & ADDRESS else "plain"


def features(lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    """For each text: the evidence of its terms (capped, logged), misspelled terms, quoted terms, aimed hits, evidence for
    the length, quoted misspelled terms.

    A term's evidence is its weight, or ``several`` where two of its words occur. A misspelled term has the same,
    halved for each edit, and is counted beside the exact ones. Terms that occur in quotations only are counted apart; an aimed hit
    counts one, halved for each edit.
    """
    low = [t.lower() for t in texts]
    found = [WORD.findall(t) for t in low]
    seen = [set(f) for f in found]
    hits = lexicon.look(list(set().union(*seen))) if seen else {}
    out = np.zeros((len(texts), FEATURES))
    for i, own in enumerate(seen):
        mine = hits.keys() & own
        if not mine:
            continue
        held: dict[tuple[bool, bool], dict[int, dict[str, int]]] = {}  # (misspelled, quoted): terms, their words and edits
        aimed = 0.0
        for m in WORD.finditer(low[i]):
            if m[0] in mine:
                number, apart = hits[m[0]]
                kind = _context(low[i], m.start(), m.end())
                held.setdefault((apart > 0, kind == "quoted"), {}).setdefault(number, {})[m[0]] = apart
                aimed += 0.5**apart if kind == "aimed" else 0

        def evidence(misspelled: bool, quoted: bool) -> float:
            terms, known = held.get((misspelled, quoted), {}), [held.get((False, False), {})]
            if quoted:
                known.append(held.get((misspelled, False), {}))
            total = 0.0
            for number, words in terms.items():
                if not (misspelled or quoted) or not any(number in k for k in known):  # what is open and exact has been counted
                    term = lexicon.terms[number]
                    total += (term.several if len(words) > 1 else term.weight) * 0.5 ** min(words.values())
            return total

        whole = evidence(False, False)
        out[i] = [min(whole, 30) / 10, *np.log1p([whole, evidence(True, False), evidence(False, True), aimed, 20 * whole / len(found[i]), evidence(True, True)])]
    return out


def learn_lexicon(sample: DataFrame, support: int = 3, most: int = 2000) -> list[Term]:
    """Words and stems that toxic documents of the sample have and next to no others; ``most`` bounds the list.

    A term needs ``support`` toxic documents, a rate 20 times that of the others, and counts that chance would not give
    once among all terms that have the support: its part of the likelihood ratio is at least 2 ln of their number. For a
    stem the words of documents that have two or more of them count; it needs one such document fewer, and five different
    words, none of which is more than half of what it finds. Of terms that start alike the most telling one is kept.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [list(set(words_of(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(words, pa.list_(pa.string()))], names=["d", "label", "words"])

    kind = sample.schema["key"].dataType.simpleString()
    bags = sample.select("key", "label", "text").mapInArrow(counted, f"d {kind}, label int, words array<string>")
    sizes = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    words = bags.select("label", "d", F.explode("words").alias("word")).where("length(word) >= 3")
    stems = F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])
    entries = words.select("label", "d", "word", F.col("word").alias("term"), F.lit(False).alias("stem")).union(
        words.select("label", "d", "word", F.explode(F.array_compact(stems)).alias("term"), F.lit(True).alias("stem")))
    per_doc = entries.groupBy("label", "d", "term", "stem").agg(F.count("*").alias("n"))
    docs_with = lambda label, test: F.sum(((F.col("label") == label) & test).cast("int"))
    once, more = F.col("n") == 1, F.col("n") > 1
    counts = per_doc.groupBy("term", "stem").agg(
        docs_with(1, once).alias("x1"), docs_with(0, once).alias("y1"), docs_with(1, more).alias("x2"), docs_with(0, more).alias("y2"),
        F.sum(F.when(more & (F.col("label") == 1), F.col("n")).otherwise(0)).alias("xw"), F.sum(F.when(more & (F.col("label") == 0), F.col("n")).otherwise(0)).alias("yw"))
    by_word = entries.where("stem AND label = 1").groupBy("term", "word").agg(F.count("*").alias("n"))
    spread = by_word.groupBy("term").agg(F.count("*").alias("variants"), F.max("n").alias("top")).withColumn("stem", F.lit(True))

    def odds(x: str, y: str) -> Column:
        return ((F.col(x) + 0.5) / (toxic + 1)) / ((F.col(y) + 1) / (clean + 2))

    x = F.when(F.col("stem"), F.col("xw")).otherwise(F.col("x1"))
    y = F.when(F.col("stem"), F.col("yw")).otherwise(F.col("y1"))
    surprise = 2 * F.col("x") * F.log(F.col("x") * (toxic + clean) / ((F.col("x") + F.col("y")) * toxic))  # its part of the likelihood ratio
    chosen = counts.where((F.col("stem") & (F.col("x2") >= support - 1)) | (~F.col("stem") & (F.col("x1") >= support)))
    chosen = chosen.withColumns({"x": x, "y": y}).withColumns({"one": odds("x1", "y1"), "two": odds("x2", "y2"), "best": odds("x", "y"), "surprise": surprise})
    tried = chosen.count()
    chosen = chosen.where((F.col("best") >= 20) & (F.col("surprise") >= 2 * math.log(max(tried, 2))))
    chosen = chosen.join(spread, ["term", "stem"], "left")
    chosen = chosen.where(~F.col("stem") | ((F.col("variants") >= 5) & (F.col("top") <= (F.col("x1") + F.col("x2")) / 2)))
    chosen = chosen.withColumn("value", F.col("surprise") * F.log("best")).orderBy(F.desc("value"), F.desc(F.length("term")), "term", "stem").limit(most)
    terms: list[Term] = []
    for r in chosen.collect():
        related = any(t.text.startswith(r["term"]) or (t.stem and r["term"].startswith(t.text)) for t in terms if t.stem or r["stem"])
        if not related:
            terms.append(Term(r["term"], r["stem"], max(0.0, math.log(r["one"])), math.log(r["two"] if r["stem"] else r["one"])))
    return terms


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    weights: np.ndarray
    offset: float


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the offset; the classes weigh the same."""
    design = np.hstack([x, np.ones((len(x), 1))])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    keep = np.append(np.full(x.shape[1], ridge), 1e-6) * len(x) / 100
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + keep * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(keep)
        w -= np.linalg.solve(curve, gradient)
    return w


def train(sample: DataFrame, support: int = 3) -> Model | None:
    """Lexicon and weights from (text, label)."""
    terms = learn_lexicon(sample, support)
    if not terms:
        warnings.warn("no term of the labelled sample tells toxic documents from others: every score will be 0", stacklevel=2)
        return None
    lexicon_terms = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_terms)
        for batch in batches:
            rows = features(lexicon, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.select("label", "text").mapInArrow(run, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    w = _logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return Model(terms, w[:-1], float(w[-1]))


def classify(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "toxic", parts: int = 4, part: int = 2, threshold: float = 0.3, per_class: int = 3000) -> DataFrame:
    """(key, held_out, score, predicted, evidence) of every row; ``evidence`` is the logged sum of its terms' weights.

    Lexicon and weights come from at most ``per_class`` labelled rows of each label outside the fold; where nothing can
    be learnt every score is 0 and a warning says so. Null texts are empty; a text without hits has the model's lowest score. Repeated rows stay.
    """
    model = train(training_sample(docs, labels, key, text, label, parts, part, per_class))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms) if model else None
        for batch in batches:
            scores = np.zeros(len(batch))
            rates = np.zeros(len(batch))
            if model:
                for a, b in slices(batch.column("text")):
                    x = features(lexicon, [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                    scores[a:b] = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.offset, -30, 30)))
                    rates[a:b] = x[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores), pa.array(rates)], names=["key", "score", "evidence"])

    scored = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double, evidence double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

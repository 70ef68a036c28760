"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are symbols; those of a word that repeats the word before it are a second set of symbols. Filters of
``WIDTH`` symbols move by ``STEP`` over chunks that overlap by ``OVERLAP`` and cover the whole text. Each filter's
largest response in a chunk is kept; the largest and the mean over the chunks give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ASCII_SPACE, column_bytes, slices, word_hashes
from tidemark.llm.labels import held_out, training_sample

WIDTH, STEP, CHUNK, OVERLAP = 8, 4, 1024, 64
PAD, SYMBOLS = 512, 513
FILTERS = 16


@dataclass(frozen=True)
class Network:
    taps: np.ndarray  # (WIDTH, SYMBOLS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: float


def symbols(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The byte, plus 256 inside a word equal to the one before it in its row."""
    out = data.astype(np.int16)
    words, counts = word_hashes(data, bounds, ASCII_SPACE, lower=False)
    if len(words) < 2:
        return out
    first = np.zeros(len(words), bool)
    ends = np.cumsum(counts)
    first[(ends - counts)[counts > 0]] = True
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & ~first[1:]
    inside = ~ASCII_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds[:-1][bounds[:-1] < len(data)]] |= inside[bounds[:-1][bounds[:-1] < len(data)]]
    number = np.cumsum(begins) - 1
    out[inside & again[np.maximum(number, 0)]] += 256
    return out


def chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) symbols, padded at the end, and the row of each chunk; an empty row has one chunk of padding."""
    whole = symbols(data, bounds)
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP)))
    rows = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = bounds[rows] + number * (CHUNK - OVERLAP)
    at = starts[:, None] + np.arange(CHUNK)
    padded = np.append(whole, np.int16(PAD))
    return padded[np.where(at < bounds[rows + 1][:, None], at, len(whole))], rows


def _responses(net: Network, part: np.ndarray) -> np.ndarray:
    """(chunks, positions, FILTERS) before the rectifier."""
    n = (CHUNK - WIDTH) // STEP + 1
    total = np.broadcast_to(net.bias, (len(part), n, FILTERS)).astype(np.float32)
    for k in range(WIDTH):
        total += net.taps[k][part[:, k : k + STEP * (n - 1) + 1 : STEP]]
    return total


def _pooled(net: Network, part: np.ndarray) -> np.ndarray:
    return np.maximum(np.concatenate([_responses(net, part[i : i + 64]).max(axis=1) for i in range(0, len(part), 64)]), 0)


def _combined(pooled: np.ndarray, rows: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    counts = np.diff(np.append(first, len(rows)))[:, None]
    return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts], axis=1)


def score(net: Network, column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in slices(column):
        part, rows = chunks(*column_bytes(column.slice(a, b - a)))
        logit = _combined(_pooled(net, part), rows) @ net.weights + net.offset
        out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return np.concatenate(out)


def fit(parts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the log loss. ``parts`` has each document's chunks; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    taps = rng.normal(0, 0.05, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
    state = {"taps": taps, "bias": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32)}
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in state.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            rows = np.repeat(np.arange(len(some)), [len(parts[j]) for j in some])
            part = np.concatenate([parts[j] for j in some])
            net = Network(state["taps"], state["bias"], state["weights"], float(state["offset"][0]))
            found = _responses(net, part)
            best = found.argmax(axis=1)
            top = np.take_along_axis(found, best[:, None], axis=1)[:, 0]
            pooled = np.maximum(top, 0)
            both = _combined(pooled, rows)
            p = 1 / (1 + np.exp(-np.clip(both @ net.weights + net.offset, -30, 30)))
            error = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            grads = {"weights": both.T @ error + 1e-4 * net.weights, "offset": np.array([error.sum()], np.float32)}
            back = error[:, None] * net.weights
            counts = np.bincount(rows, minlength=len(some))[:, None]
            to_mean = (back[:, FILTERS:] / counts)[rows]
            largest = both[:, :FILTERS][rows]
            to_max = np.where(pooled >= largest, back[:, :FILTERS][rows], 0)
            to_top = np.where(top > 0, to_mean + to_max, 0).astype(np.float32)
            grads["bias"] = to_top.sum(axis=0)
            change = np.zeros_like(taps)
            column = np.broadcast_to(np.arange(FILTERS), best.shape)
            for k in range(WIDTH):
                seen = np.take_along_axis(part, best * STEP + k, axis=1)
                np.add.at(change[k], (seen, column), to_top)
            grads["taps"] = change
            step += 1
            for name, grad in grads.items():
                m, v = moments[name]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                state[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Network(state["taps"], state["bias"], state["weights"], float(state["offset"][0]))


def train(sample: DataFrame, per_document: int = 4) -> Network | None:
    """The network fitted to (text, label); of a long training text ``per_document`` chunks spread over it are used."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bytes] = []
            for a, b in slices(batch.column("text")):
                part, rows = chunks(*column_bytes(batch.column("text").slice(a, b - a)))
                for row in range(b - a):
                    own = part[rows == row]
                    kept.append(own[np.unique(np.linspace(0, len(own) - 1, per_document).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(kept, pa.binary())], names=["key", "label", "part"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "label", "text").mapInArrow(cut, f"key {kind}, label int, part binary").collect()
    rows.sort(key=lambda r: (r["key"], bytes(r["part"])))
    labels = np.array([r["label"] for r in rows])
    if len(set(labels.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["part"], np.int16).reshape(-1, CHUNK) for r in rows], labels)


def classify(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str = "quality", parts: int = 5, part: int = 0, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """(key, held_out, score, predicted) of every row.

    The network learns from at most ``per_class`` labelled rows of each label outside the fold; without both labels
    every score is 0.5. A null text is empty, and empty texts have one score. Repeated rows stay.
    """
    net = train(training_sample(docs, labels, key, text, label, parts, part, per_class))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(len(batch), 0.5) if net is None else score(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64())], names=["key", "score"])

    scored = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str, text: str, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    net = train(training_sample(docs, labels, key, text, options.get("label", "quality"), options.get("parts", 5), options.get("part", 0), options.get("per_class", 1500)))
    if net is None:
        return docs
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(net, batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

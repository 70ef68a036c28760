"""Hard negatives against a plain version: ties, repeated rows, nulls, several dimensions, very large components."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "id bigint, label int, vec array<float>, score string, block string, slot string, dim string, grp string"
LAST = 2**63


def plain(rows, every=10, k=5, keep=10, low=30, high=90):
    good = [(i, l, [math.floor(256.0 * x) for x in v]) for i, l, v, *_ in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for i, l, v in good:
        if i is None or i % every:
            continue
        scored = [(-max(-LAST, min(LAST - 1, sum(a * b for a, b in zip(v, w)))), LAST if j is None else j, j, m) for j, m, w in good if len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for p, _, j, _ in [s for s in scored if s[3] == l and s[2] != i][:k]:
            fit = [s for s in scored if s[3] != l and low * -p <= 100 * -s[0] <= high * -p][:keep]
            out.update((i, j, r, s[2], -p, -s[0]) for r, s in enumerate(fit, 1))
    return out


def mined(spark, rows):
    df = spark.createDataFrame([(*r, *["?"] * 5) for r in rows], SCHEMA).repartition(3)
    out = negatives.mine(df, F.col("id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(tuple(r) for r in out.collect())


def made(seed, n, spread):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.randrange(-spread, spread + 1) / 16 for _ in range(6)]) for i in range(n)]
    rows += [rows[10], (10, 1, rows[20][2]), (None, 0, rows[30][2]), (None, 1, rows[40][2])]  # a repeated row, a repeated id, null ids
    rows += [(1000, None, rows[0][2]), (1010, 1, None), (1020, 1, [None] * 6), (1030, 1, [math.nan] * 6), (1040, 2, [math.inf] + [0.0] * 5)]
    rows += [(2000 + i, i % 2, [1.0 + i / 64, 2.0]) for i in range(40)] + [(3000 + i, i % 2, []) for i in range(12)]  # other dimensions
    return rows


@pytest.mark.parametrize("size,spread", [(7, 2), (64, 16), (16384, 40)])
def test_against_plain(spark, monkeypatch, size, spread):
    """Few values make many ties; small blocks make many cells and slots that are merged over them."""
    monkeypatch.setattr(negatives, "ROWS", size)
    monkeypatch.setattr(negatives, "ANCHORS", size)
    rows = made(size, 300, spread)
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_scores_that_no_double_holds(spark):
    rows = [(i, i % 2, [float(1 + i % 5) * 2.0**22, float(i) * 2.0**21, 3.0]) for i in range(30)]
    rows += [(100 + i, i % 2, [1e30 * (1 + i), 1.0, 2.0]) for i in range(4)]
    assert mined(spark, rows) == plain(rows)


def test_nothing_to_mine(spark):
    assert not mined(spark, []) and not mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])])
    assert not mined(spark, [(10, 0, [1.0]), (2, 0, [-1.0]), (3, 1, [-1.0])])  # the positive's score is below zero
    assert not mined(spark, [(10, 0, [1.0]), (20, 0, [1.0])])  # no other label

"""What a review found left out: each case here was lost, merged or unbounded before."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from tidemark.llm import minhash, suffixes


def edited(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_similarity_is_a_parameter(table):
    """4 of 200 words replaced: 176 of 216 shingles are shared, 0.815."""
    rng, rows = random.Random(7), []
    for i in range(30):
        words = [f"w{i}x{j}" for j in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, {10 + 48 * k + rng.randrange(20) for k in range(4)}))]
    at = {p: {r["doc_id"] for r in minhash.near_duplicates(table(rows), "doc_id", "text", p).where("kept").collect()} for p in (80, 85)}
    assert at == {80: set(range(0, 60, 2)), 85: set(range(60))}
    assert [(minhash.radius(p, 32, 16), minhash.radius(p, 256, 8)) for p in (85, 80)] == [(15, 64), (17, 80)]


@pytest.mark.parametrize("bound", [4000, 1 << 20])
def test_strings_around_a_common_phrase_are_dealt(table, monkeypatch, bound):
    """A phrase in all documents with another text around each: one name, and hardly two equal strings."""
    rng, shards = random.Random(8), []
    phrase = "http://www.example.org/archive/"
    prose = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(i, prose(40) + phrase + prose(40)) for i in range(400)]
    rows += [(1000 + i, prose(9) + rows[i % 400][1][rng.randrange(30) :] + prose(9)) for i in range(300)]

    def owners(strings, of=suffixes._owners):
        shards.append(max(r[1] or 0 for r in strings.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.octet_length("data"))).collect()))
        return of(strings)

    monkeypatch.setattr(suffixes, "_owners", owners)
    got = suffixes.remove_repeats(table(rows), "doc_id", "text", name_bytes=bound).collect()
    want = collections.Counter((k, *u) for (k, _), u in zip(rows, plain.uncovered(rows)))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert len(shards) == 1 and (shards[0] < 4 * bound if bound == 4000 else shards[0] > 30_000)


def test_the_pipeline_removes_rows_not_ids(spark, table):
    words = [f"w{j}" for j in range(200)]
    base, near, other, third = " ".join(words), edited(words, {100}), "one text that nothing else is like", "and another text that is not like it"
    rows = [(None, base), (None, near), (None, other), (4, base), (4, third), (4, base), (4, near), (9, base), (None, third + " at all"), (None, None), (None, ""), (7, None), (7, "")]
    rows += [(12, "the same text twice under one id"), (12, "the same text twice under one id"), (None, "no id but the same text twice"), (None, "no id but the same text twice")]
    out = corpus_pipeline.distinct_documents(spark, table(rows), "")
    first = min(base, near, key=plain.sha)
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(
        [(4, first), (4, third), (None, other), (None, third + " at all"), (None, None), (None, ""), (7, None), (7, ""), rows[13], rows[15]])
    assert out.columns == table(rows).columns


@pytest.mark.parametrize("block", [4, 4096])
def test_open_keys_cost_rows_in_proportion(table, monkeypatch, block):
    """Near copies at about the similarity, so that hubs leave some apart: one result for all sizes of blocks and tasks."""
    rng, dealt = random.Random(9), []
    base = [f"w{j}" for j in range(120)]
    rows = [(i, edited([f"{w}" for w in base], {rng.randrange(120) for _ in range(rng.randrange(1, 4))}).replace("new", f"n{i % 40}x")) for i in range(160)]

    def counted(open_, of=minhash._dealt):
        out = of(open_)
        dealt.append((open_.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_dealt", counted)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STRIPE", 3)
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 300 if block == 4 else 1 << 21)
    monkeypatch.setattr(minhash, "FEW", 0)  # no further hubs
    out = minhash.near_duplicates(table(rows), "doc_id", "text")
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == dict(zip((k for k, _ in rows), plain.components(rows)))
    (before, after), = dealt
    assert 0 < before and (after == before if block == 4096 else after > before)


def test_main_component_meets_the_others_only(spark, monkeypatch):
    """One class apart from n connected ones costs n rows and one for each block."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(1, 0, bytes([i]), b"main" if i else b"other", 9, [0], [0]) for i in range(200)]
    dealt = minhash._dealt(spark.createDataFrame(rows, "place bigint, k int, cls binary, label binary, n bigint, sig array<bigint>, wide array<bigint>")).collect()
    assert len(dealt) == 199 + 1 + 25 and {r["i"] for r in dealt} == {0}

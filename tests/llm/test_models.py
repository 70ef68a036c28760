"""Classifiers on held-out rows of the small tables, the automata and the suffix order against plain versions, the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import plain
from tests.oracle import compare, connect
from tidemark.llm import induced, queries, quality, toxicity
from tidemark.llm.toxicity import Lexicon, Term

FOLDER = "/root/testdata/sf0.01"


def held_out_scores(spark, out, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    scores, truth = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    high, low = scores[truth == 1][:, None], scores[truth != 1]
    return (high > low).mean() + (high == low).mean() / 2, np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_is_learnt(spark):
    out = queries.op6_quality_classifier(spark, FOLDER)
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    area, right = held_out_scores(spark, out, "quality")
    assert area > 0.95 and right > 0.9


def test_toxicity_is_learnt(spark):
    area, right = held_out_scores(spark, queries.op7_toxicity(spark, FOLDER), "toxic")
    assert area > 0.9 and right > 0.9


@pytest.mark.parametrize("classify,label", [(quality.classify, "quality"), (toxicity.classify, "toxic")])
def test_scores_of_odd_tables(spark, table, classify, label):
    rows = [(i, ("bad!! " if i % 2 else "fine words ") * (i % 9 + 2)) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (5, "twice"), (102, "ä" * 5000)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (61, None, None)], "doc_id bigint, quality int, toxic int")
    out = classify(table(rows), labels, "doc_id", "text").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[100] == by[101]
    assert classify(table(rows).where("false"), labels, "doc_id", "text").count() == 0
    assert classify(table(rows), labels.where("false"), "doc_id", "text").count() == len(rows)


def test_held_out_rows_are_those_of_the_checksum(spark, table):
    import zlib

    from pyspark.sql import functions as F
    from tidemark.llm.labels import held_out

    got = {r["doc_id"]: r["h"] for r in table([(i, "") for i in range(200)]).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_the_whole_text_counts():
    import pyarrow as pa

    data, bounds = np.frombuffer(b"a" * 5000 + b"bb bb", np.uint8), np.array([0, 5000, 5005])
    part, rows = quality.chunks(data, bounds)
    assert rows.tolist() == [0] * 6 + [1] and (part[5] == quality.PAD).any() and part[6][3] == ord("b") + 256
    net = quality.Network(np.zeros((quality.WIDTH, quality.SYMBOLS, quality.FILTERS), np.float32), np.zeros(quality.FILTERS, np.float32), np.ones(2 * quality.FILTERS, np.float32), 0.0)
    net.taps[0, ord("z")] = 9
    assert quality.score(net, pa.array(["a" * 9000 + "zzzzzz", "a" * 9000])).round(2).tolist() == [1.0, 0.5]


def test_automata_find_what_edit_distance_finds():
    rng = random.Random(2)
    for _ in range(60):
        terms = [Term("".join(rng.choice("abc") for _ in range(rng.randrange(3, 11))), rng.random() < 0.4, 1.0) for _ in range(6)]
        words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)})
        got = Lexicon(terms).look(words)
        for word in words:
            near = []
            for number, term in enumerate(terms):
                row = plain.lexicographic_distance(term.text, word)
                apart = min(row) if term.stem else row[-1]
                if apart <= term.reach:
                    near.append((apart, number))
            assert (got.get(word) or (None, None))[::-1] == (min(near) if near else (None, None))


def test_quotation_is_told_from_abuse():
    lexicon = Lexicon([Term("scoundrel", False, 5.0, 5.0)])
    x = toxicity.features(lexicon, ["You scoundrel!", 'they wrote "scoundrel" once', "a scoundrol came", "", "nothing here"])
    assert x[0][1] > 0 and x[0][4] > 0 and x[1][1] == 0 and x[1][3] > 0 and x[2][1] == 0 and x[2][2] > 0 and not x[3:].any()


def test_misspelled_terms_have_weight_and_context():
    lexicon = Lexicon([Term("scoundrel", False, 5.0, 5.0), Term("blackguardly", False, 3.0, 3.0)])
    texts = ["a scoundrol came", 'they wrote "scoundrol" once', "you scoundrol", "a blackguardli came", "a blackgardli came", "the scoundrel, a scoundrol", "a scoundrel came"]
    x = toxicity.features(lexicon, texts)
    assert len({tuple(r) for r in x.round(9)}) == len(texts)
    assert x[0][2] > 0 and not x[0][6] and x[1][6] > 0 and not x[1][2] and x[2][4] > 0 and not x[0][4]
    assert x[0][2] > x[3][2] > x[4][2] > 0  # by weight, and less with each edit
    assert x[5][2] == 0 and (x[5][:2] == x[6][:2]).all()  # what is there exactly is not counted again


def test_an_empty_lexicon_is_not_silent(spark, table):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    with pytest.warns(UserWarning, match="every score will be 0"):
        out = toxicity.classify(table([(i, "the same words in all") for i in range(40)]), labels, "doc_id", "text")
    assert {r["score"] for r in out.collect()} == {0.0}


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_suffixes_come_in_order(monkeypatch, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = random.Random(3)
    for trial in range(60):
        strings = [bytes(rng.choice(b"\x00ab\xff" if trial % 2 else b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))]
        text, bounds = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings]))
        end = np.repeat(bounds[1:], np.diff(bounds))
        order = np.concatenate(list(induced.suffix_order(text, bounds, 5)))[::-1]
        keys = [tuple(x + 1 for x in text[p : end[p]].tobytes()[:5]) for p in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        groups = {}
        for position, group in np.concatenate(list(induced.equal_groups(text, bounds, 3)) or [np.zeros((0, 2), int)]).tolist():
            groups.setdefault(group, set()).add(text[position : position + 3].tobytes())
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_queues_spill(monkeypatch):
    queue = induced.Queue(held=10)
    for i in range(0, 100, 7):
        queue.put(np.arange(i, min(i + 7, 100), dtype=np.int64))
    assert queue.file is not None and np.concatenate(list(queue.reversed())).tolist() == list(range(99, -1, -1))
    assert np.concatenate(list(queue.take())).tolist() == list(range(100))


@pytest.mark.parametrize("name", ["op1_secret_scans", "op3_minhash_near_dedup", "op10_benchmark_decontamination"])
def test_query_against_sql(spark, name):
    query = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert compare(query, connect("/root/testdata/sf0.001"), queries.SQL[name]) is None


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "mixing sources"]
    kept = docs
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = corpus_pipeline.stored(stage(spark, kept, FOLDER), "test")
        assert kept.columns == columns
        texts[name] = (before, {r["doc_id"]: r["text"] for r in kept.collect()})
    before, after = texts["quality classifier"]
    assert set(after) < set(before) and all(after[k] == before[k] for k in after)
    before, after = texts["minhash near-dedup"]
    rows = sorted(before.items())
    assert set(after) == {k for (k, _), c in zip(rows, plain.components(rows)) if k == c}
    before, after = texts["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {k: plain.leaks(t, items) for k, t in before.items()}
    assert all(after[k] == t for k, t in before.items() if not hit[k][4])
    assert set(before) - set(after) == {k for k, (n, n_hit, *_) in hit.items() if n_hit and n_hit >= n / 2}
    before, after = texts["secret scans"]
    assert set(after) == set(before) and all(after[k] == t for k, t in before.items() if not any(plain.secrets(t)[:3]))
    assert all(not any(plain.secrets(t)[:3]) for t in after.values())
    last = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert {r["doc_id"] for r in last} <= set(after) and max(r["epoch"] for r in last) <= 2

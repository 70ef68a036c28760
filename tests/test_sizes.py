"""Compatibility of subjects of every size: small ones whole in one shuffle, large ones cut into ranges of versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import alerts as A
from tidemark.operators import governance as G
from tidemark.operators.steps import at_steps
from tidemark.plans import PLANS

START = datetime(2024, 1, 1)

SCHEMA = "subject string, version int, field string, type string, has_default boolean, symbols array<string>"


def made(seed):
    """Subjects of 1 to 40 versions, among them one with a field that comes and goes, and one without a name."""
    rng, rows = random.Random(seed), []
    for s, versions in (("one", 1), ("small", 4), ("large", 40), ("gone", 20), (None, 5)):
        for v in sorted(rng.sample(range(1, 200), versions)):
            for f in rng.sample("abcde", rng.randrange(1, 6)):
                symbols = rng.sample("XYZ", rng.randrange(1, 4)) if f == "e" else None
                rows.append((s, v, f, "E" if symbols else rng.choice(["int", "long", "string", "map"]), rng.random() < 0.5, symbols))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("mode", ["BACKWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE"])
def test_sizes_give_the_same(spark, monkeypatch, mode):
    df = spark.createDataFrame(made(5), SCHEMA)
    cut = rows_of(G.check_compatibility(df, mode, width=30, whole=0))
    assert len(cut) == 65 and len({r[-1] for r in cut}) == 2
    assert rows_of(G.check_compatibility(df, mode, width=30, whole=20)) == cut
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert rows_of(G.check_compatibility(df, mode, width=30)) == cut


def test_sizes_give_the_same_by_subject(spark):
    df = spark.createDataFrame(made(6), SCHEMA)
    modes = spark.createDataFrame([("small", "FORWARD"), ("large", "FULL_TRANSITIVE"), ("gone", "BACKWARD")], "subject string, compatibility string")
    cut = rows_of(G.check_compatibility_by_subject(df, modes, width=30, whole=0))
    assert len(cut) == 65 and rows_of(G.check_compatibility_by_subject(df, modes, width=30, whole=20)) == cut
    assert rows_of(G.check_compatibility_by_subject(df, modes, width=30)) == cut


def test_small_subjects_take_one_shuffle(spark):
    """All steps after the count of rows, so that what moves is the input once."""
    df = spark.createDataFrame([r[:5] for r in made(7)], SCHEMA.rsplit(",", 1)[0])
    for mode in ("FULL", "FULL_TRANSITIVE"):
        text = G.check_compatibility(df, mode)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_tasks_follow_the_number_of_rows(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    assert session.dealt(df, session.TASK_ROWS, "k") is df
    text = session.dealt(df, 40 * session.TASK_ROWS, "k")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in text and ", 40)" in text


def test_points_unfold_after_the_sorts(spark):
    """A task holds marks, two a sample, not the points between them: one sample a day at steps of a second."""
    df = spark.range(3).selectExpr("'a' AS k", "timestamp_seconds(id * 86400 + 1) AS ts", "id * 5 AS value")
    out = at_steps(df, "k", "1 second", "2 days")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and text.index("Generate explode(sequence(_k") < text.index("Sort [")
    got = out.groupBy("samples", "last", "increase").count().collect()
    assert sorted(tuple(r[c] or 0 for c in r.asDict()) for r in got) == [
        (1, 0, 0, 86400), (1, 10, 0, 86400), (2, 5, 5, 86400), (2, 10, 5, 86400)]


def test_runs_of_one_time_stay_apart(spark):
    """Breach, quiet, breach at one time are two runs; the first goes on from the slice before."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", at(t), v, i) for i, (t, v) in enumerate([(8, 9.0), (11, 7.0), (11, 1.0), (11, 8.0), (11, 2.0), (11, 6.0), (12, 0.0), (25, 9.0)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, value double, seq long").withColumn("metric", F.lit("m"))
    for width in ("10 seconds", "1 hour"):
        out = A.alert_sustained(df, [A.Rule("hot", "m", "gt", 5.0, 0, "warn")], "k", max_gap="5 seconds", order="seq", width=width)
        got = sorted((r["started"], r["last_seen"], r["samples"], r["peak"]) for r in out.collect())
        assert got == [(at(8), at(11), 2, 9.0), (at(11), at(11), 1, 6.0), (at(11), at(11), 1, 8.0), (at(25), at(25), 1, 9.0)]


def test_runs_are_found_in_sorted_order(spark):
    """Samples are sorted once and not grouped: the only groups are those of runs in several slices."""
    text = PLANS["alerts_sustained"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Aggregate(") == 2 and text.count("Sort [") == 2

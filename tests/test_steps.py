"""Values at evaluation steps against a plain version."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.operators import series as S
from tidemark.operators.steps import at_steps

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, step, back, stale=None):
    """By (series, seconds of the grid point): samples, last, increase, elapsed."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, v) for key, t, v in rows if key == k and t is not None and v is not None)
        for at in range(0, 4000 + back, step):
            held = [(t, v) for t, v in own if at - back < t <= at]
            if held:
                grown = sum(b - a if b >= a else b for (_, a), (_, b) in zip(held, held[1:]))
                elapsed = held[-1][0] - held[0][0]
                last = held[-1][1] if at - held[-1][0] < (stale or back) else None
                out[k, at] = (len(held), last, grown if elapsed else None, elapsed * 10**6 if elapsed else None)
    return out


def table(spark, rows):
    at = lambda t: None if t is None else START + timedelta(seconds=t)
    return spark.createDataFrame([(k, at(t), v, "?") for k, t, v in rows], "k string, ts timestamp, value bigint, window string")


def seconds(r):
    return int((r["at"].replace(tzinfo=timezone.utc) - START).total_seconds())


def made(seed):
    rng = random.Random(seed)
    rows = [(k, t, rng.randrange(100)) for k in ("a", "b", None) for t in rng.sample(range(4000), 200)]
    rows += [("sparse", t, t) for t in (5, 60, 1300, 3999)] + [("one", 77, 5), ("a", None, 3), ("b", 9, None)]
    return rows


@pytest.mark.parametrize("step,back,width,stale", [(30, 60, 100, None), (60, 60, 5000, 20), (45, 700, 100, 100), (300, 50, 60, None), (6, 1000, 100, None)])
def test_against_plain(spark, step, back, width, stale):
    rows = made(step)
    got = at_steps(table(spark, rows), "k", f"{step} seconds", f"{back} seconds", width=width * 10**6, stale=None if stale is None else f"{stale} seconds").collect()
    assert {(r["k"], seconds(r)): (r["samples"], r["last"], r["increase"], r["elapsed_us"]) for r in got} == plain(rows, step, back, stale)
    assert len(got) == len({(r["k"], seconds(r)) for r in got})
    assert all(r["rate"] is None if r["increase"] is None else r["rate"] == r["increase"] / (r["elapsed_us"] / 1e6) for r in got)


def test_several_lookbacks_in_one_scan(spark):
    rows = made(3)
    df = table(spark, rows)
    out = at_steps(df, "k", "60 seconds", {"short": "2 minutes", "long": "10 minutes"})
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    got = {w: {(r["k"], seconds(r)): (r["samples"], r["last"], r["increase"], r["elapsed_us"]) for r in out.collect() if r["window"] == w} for w in ("short", "long")}
    for w, back in (("short", 120), ("long", 600)):
        assert {k: (v[0], *v[2:]) for k, v in got[w].items()} == {k: (v[0], *v[2:]) for k, v in plain(rows, 60, back).items()}


def test_nothing_at_steps(spark):
    assert at_steps(table(spark, []), "k", "1 minute", "5 minutes").count() == 0


@pytest.mark.parametrize("lookback", ["5 minutes", "6 hours"])
def test_repeated_samples_stay_single(spark, lookback):
    """Two samples a minute with one time each: as many rows come out as went in, whatever the look-back."""
    rows = [("a", 60 * (i // 2), i) for i in range(400)] + [("b", 0, 1), ("b", 0, 1)]
    out = S.increase(table(spark, rows), "k", lookback).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"k", "ts", "value", "window", "increase"}
    per_time = {}
    for r in out:
        per_time.setdefault((r["k"], r["ts"]), set()).add(r["increase"])
    assert all(len(v) == 1 for v in per_time.values())

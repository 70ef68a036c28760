import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import series as S

START = datetime(2024, 1, 1)


def counter(seed: int, n: int = 150):
    rng = random.Random(seed)
    out = []
    for key in ("a", "b"):
        value, t = 0, START
        for _ in range(n):
            t += timedelta(seconds=rng.choice([1, 5, 20, 90]))
            value = rng.randrange(5) if rng.random() < 0.1 else value + rng.randrange(10)
            out.append((key, t, value))
    return out


@pytest.mark.parametrize("width", ["1 second", "10 minutes"])
def test_counter_window(spark, width):
    rows = counter(1)
    df = spark.createDataFrame(rows, "k string, ts timestamp, value long")
    got = {(r["k"], r["ts"]): (r["increase"], r["elapsed_us"]) for r in S.counter_window(df, "k", "1 minute", width=width).collect()}
    assert len(got) == len(rows)
    for k, ts, _ in rows:
        inside = sorted((t, v) for key, t, v in rows if key == k and ts - timedelta(minutes=1) < t <= ts)
        if len(inside) < 2:
            assert got[(k, ts)] == (None, None)
            continue
        grown = sum(b - a if b >= a else b for (_, a), (_, b) in zip(inside, inside[1:]))
        assert got[(k, ts)] == (grown, int((inside[-1][0] - inside[0][0]).total_seconds() * 1e6))


@pytest.mark.parametrize("width", ["3 seconds", "1 hour"])
def test_state_history(spark, width):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), START + timedelta(seconds=i * rng.choice([1, 1, 2])), rng.choice(["UP", "UP", "DOWN", None]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, state string, seq long")
    got = sorted((r["k"], r["since"], r["until"], r["state"]) for r in S.state_history(df, "k", "ts", "state", "seq", width).collect())
    want = []
    for key in "ab":
        mine = sorted((t, s, st) for k, t, st, s in rows if k == key)
        changes = [m for i, m in enumerate(mine) if i == 0 or m[2] != mine[i - 1][2]]
        want += [(key, c[0], changes[i + 1][0] if i + 1 < len(changes) else None, c[2]) for i, c in enumerate(changes)]
    key = lambda r: (r[0], r[1], r[2] or datetime.max, r[3] or "")
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile(spark, q):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice("xyz"), float(rng.randrange(1000)) if rng.random() < 0.9 else None) for _ in range(5000)] + [("one", 7.0)]
    got = {r["k"]: r["p"] for r in S.percentile(spark.createDataFrame(rows, "k string, value double"), q, "k").collect()}
    for k in ("x", "y", "z", "one"):
        assert got[k] == pytest.approx(np.quantile([v for g, v in rows if g == k and v is not None], q), abs=1e-9)
    everything = S.percentile(spark.createDataFrame(rows, "k string, value double"), q, ()).collect()[0]["p"]
    assert everything == pytest.approx(np.quantile([v for _, v in rows if v is not None], q), abs=1e-9)


@pytest.mark.parametrize("q", [0.01, 0.5, 0.999])
def test_percentile_of_large_groups(spark, q):
    import numpy as np

    rng = random.Random(4)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(-3, 3) for _ in range(20000)] + [5.0] * 9000
    df = spark.createDataFrame([(v,) for v in values], "value double")
    got = S.percentile(df, q, (), bins=16).collect()[0]["p"]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-12)


def test_percentile_matches_sql(spark):
    import duckdb

    rng = random.Random(5)
    values = [round(rng.expovariate(1), 3) for _ in range(3000)]
    want = duckdb.sql(f"SELECT quantile_cont(v, 0.9) FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()[0][0]
    got = S.percentile(spark.createDataFrame([(v,) for v in values], "value double"), 0.9, (), bins=3).collect()[0]["p"]
    assert got == pytest.approx(want, abs=1e-12)


def test_state_history_of_one_long_series(spark):
    """Runs of a series over many slices: each ends where the next one begins."""
    rows = [("a", START + timedelta(minutes=10 * i), "up" if i // 3 % 2 else "down") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, state string")
    got = sorted((r["since"], r["until"], r["state"]) for r in S.state_history(df, "k", "ts", "state").collect())
    assert len(got) == 1000 and got[-1][1] is None
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(got, got[1:]))


def test_histogram_quantile(spark):
    inf = float("inf")
    rows = [("a", 1.0, 10.0), ("a", 2.0, 30.0), ("a", 4.0, 40.0), ("a", inf, 40.0),
            ("tail", 1.0, 1.0), ("tail", 2.0, 2.0), ("tail", inf, 100.0),
            ("open", 1.0, 5.0), ("empty", 1.0, 0.0), ("empty", inf, 0.0)]
    df = spark.createDataFrame(rows, "k string, le double, value double")
    got = {r["k"]: r["quantile"] for r in S.histogram_quantile(df, 0.5, "k").collect()}
    assert got == {"a": pytest.approx(1.5), "tail": 2.0, "open": None, "empty": None}


def test_or_zero_and_ratio(spark):
    empty = spark.createDataFrame([], "n long")
    assert [r["n"] for r in S.or_zero(empty, "n").collect()] == [0]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a long")
    b = spark.createDataFrame([("x", 4), ("y", 0)], "k string, b long")
    assert {r["k"]: r["percent"] for r in S.ratio(a, b, "k", "a", "b").collect()} == {"x": 25.0, "y": None}


def test_counts_and_top(spark):
    df = spark.createDataFrame([("a", 1, START, 5.0), ("a", 2, START + timedelta(1), 3.0), ("b", 1, START, 4.0)], "k string, id long, ts timestamp, value double")
    assert S.count_distinct(df, "id", approximate=True).collect()[0]["n"] == 2
    assert [(r["k"], r["value"]) for r in S.top_series(df, "k", 1).collect()] == [("b", 4.0)]
    assert S.approx_percentile(df, 0.5, "k").count() == 2

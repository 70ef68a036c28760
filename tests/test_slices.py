"""Sliced scans against plain per-key loops, with slices so narrow that every edge case occurs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.slices import scan, trailing_sums
from tidemark.operators.joins import asof_join

START = datetime(2024, 1, 1)


def events(seed: int, n: int = 300, keys: int = 3, seconds: int = 900):
    """Rows (key, ts, seq, v): one key holds about a third, and some times repeat."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(keys)}"
        ts = START + timedelta(seconds=rng.randrange(seconds))
        out.append((key, ts, i, rng.randrange(100) if rng.random() < 0.7 else None))
    return out


SCHEMA = "k string, ts timestamp, seq long, v long"


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("seed,width", [(1, "10 seconds"), (2, "1 minute"), (3, "1 hour")])
def test_scan(spark, seed, width):
    rows = events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    out = scan(
        df, "k", "ts", "seq", previous={"p": "v", "pt": "ts"}, following={"n": "v", "nt": "ts"},
        running={"total": ("sum", "v"), "held": ("last", "v"), "bits": ("bit_or", "v")},
        before={"low": ("min", "v"), "high": ("max", "v")}, width=width,
    )
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        for i, (_, _, seq, _) in enumerate(group):
            r, seen = got[seq], [g[3] for g in group[: i + 1] if g[3] is not None]
            prior = [g[3] for g in group[:i] if g[3] is not None]
            assert (r["p"], r["pt"]) == ((group[i - 1][3], group[i - 1][1]) if i else (None, None))
            assert (r["n"], r["nt"]) == ((group[i + 1][3], group[i + 1][1]) if i + 1 < len(group) else (None, None))
            assert r["total"] == (sum(seen) if seen else None)
            assert r["held"] == (seen[-1] if seen else None)
            bits = 0
            for s in seen:
                bits |= s
            assert r["bits"] == (bits if seen else None)
            assert (r["low"], r["high"]) == ((min(prior), max(prior)) if prior else (None, None))


def test_scan_over_numbers(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 5, 7, 2000, 2001)], "k string, version long")
    out = scan(df, "k", "version", previous={"p": "version"}, width=3)
    assert sorted((r["version"], r["p"]) for r in out.collect()) == [(1, None), (5, 1), (7, 5), (2000, 7), (2001, 2000)]


@pytest.mark.parametrize("width", ["1 second", "1 minute", "1 hour"])
def test_trailing_sums(spark, width):
    rows = [(k, t, s, v or 0) for k, t, s, v in events(4)]
    df = spark.createDataFrame([*rows, ("hot", None, 9999, 5)], SCHEMA)
    out = trailing_sums(df, "k", "ts", "45 seconds", {"s": "v"}, width)
    got = {r["seq"]: r["s"] for r in out.collect()}
    assert len(got) == len(rows)
    for key, ts, seq, _ in rows:
        want = sum(v for k, t, _, v in rows if k == key and ts - timedelta(seconds=45) < t <= ts)
        assert got[seq] == want


@pytest.mark.parametrize("how,width,salts", [("inner", "5 seconds", 1), ("left", "1 minute", 3), ("left", "1 hour", 1)])
def test_asof(spark, how, width, salts):
    left = events(5) + [(None, START, 1000, 1), ("hot", None, 1001, 1)]
    right = events(6, 120) + [(None, START, 1000, 5)]
    l = spark.createDataFrame(left, SCHEMA)
    r = spark.createDataFrame(right, "k string, vt timestamp, ver long, val long")
    out = asof_join(l, r, "k", "ts", "vt", order="ver", how=how, width=width, salts=salts)
    got = {x["seq"]: (x["ver"], x["val"]) for x in out.collect()}
    want = {}
    for k, ts, seq, _ in left:
        fits = [v for v in right if k is not None and ts is not None and v[0] == k and v[1] <= ts]
        if fits:
            best = max(fits, key=lambda v: (v[1], v[2]))
            want[seq] = (best[2], best[3])
        elif how == "left":
            want[seq] = (None, None)
    assert got == want


def test_asof_refuses_clashing_names(spark):
    df = spark.createDataFrame([("a", START, 1, 1)], SCHEMA)
    with pytest.raises(ValueError):
        asof_join(df, df.withColumnRenamed("ts", "vt"), "k", "ts", "vt")


def test_hot_key_is_spread(spark):
    """The rows of one key lie in many partitions when they are put in order."""
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scan(df, "k", "ts", previous={"p": "seq"}, width="1 hour")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("p").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.4 * 20000

"""Sustained alerts on a stream: equal to the batch form over restarts, one row of state per series."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidemark.operators.alerts import Rule, alert_sustained
from tidemark.operators.windows import with_event_time
from tidemark.streaming.alerts import alert_sustained_stream
from tidemark.streaming.run import drained, run_to_parquet, use_rocksdb

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
RULES = (Rule("high", "load", "gt", 5.0, 120, "alert"), Rule("at-once", "load", "ge", 9.0, 0, "alert"), Rule("low", "load", "lt", 2.0, 60, "warn"))
SCHEMA = "host string, zone int, ts timestamp, seq bigint, value double, metric string"


def parts():
    rng, out = random.Random(9), [[] for _ in range(4)]
    level, n = {}, 0
    for i in range(600):
        for host, zone in (("a", 1), ("a", 2), ("b", None), (None, 1)):
            if host == "b" and i > 300 or rng.random() < 0.03:
                continue  # one series falls silent, and samples are missing
            level[host, zone] = min(10, max(0, level.get((host, zone), 4) + rng.choice((-1, 0, 0, 1))))
            n += 1
            value = None if rng.random() < 0.02 else float(level[host, zone])
            out[i // 150].append((host, zone, START + timedelta(seconds=10 * (i // 2)), n, value, rng.choice(["load"] * 30 + ["other"])))
    for p in out:
        rng.shuffle(p)
    return out


def stepped(spark, tmp_path, rows, gap="1 minute"):
    """Run the stream again for each part; after each, the state's rows."""
    use_rocksdb(spark)
    sizes = []
    for part in rows:
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        raw = with_event_time(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts", "5 seconds")
        out = alert_sustained_stream(raw, RULES, ["host", "zone"], max_gap=gap, order="seq")
        drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
        state = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "run").load()
        sizes.append([r["k"] for r in state.select("key.k").collect()])
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out"), sizes


def test_equals_batch_over_restarts(spark, tmp_path):
    rows = parts()
    got, sizes = stepped(spark, tmp_path, rows)
    every = [r for p in rows for r in p]
    batch = alert_sustained(spark.createDataFrame(every, SCHEMA), RULES, ["host", "zone"], max_gap="1 minute", order="seq")
    shared = ["rule", "host", "zone", "started", "samples", "peak", "hold_s", "severity", "fired_at"]
    want = {tuple(r) for r in batch.select(*shared, "last_seen").collect()}
    ended = [tuple(r) for r in got.filter("state = 'resolved'").select(*shared, "seen").collect()]
    fired = got.filter("state = 'firing'").select("rule", "host", "zone", "started").collect()
    open_ = want - set(ended)
    assert len(ended) == len(set(ended)) > 20 and set(ended) <= want
    last = max(r[2] for r in every).replace(tzinfo=None)
    assert all(r[-1] >= last - timedelta(minutes=1, seconds=6) for r in open_)
    assert {tuple(r) for r in fired} == {(*r[:3], r[3]) for r in want} and len(fired) == len(want)
    assert all(len(s) == len(set(s)) <= 4 * len(RULES) for s in sizes)
    assert not [k for k in sizes[-1] if '"b"' in k] and [k for k in sizes[1] if '"b"' in k]  # a silent series is forgotten


def test_older_samples_and_times_that_are_missing(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("a", 1, at(s), s, 7.0, "load") for s in (0, 60, 130)] + [("a", 1, None, 5, 7.0, "load")], [("a", 1, at(100), 1, 0.0, "load"), ("a", 1, at(150), 2, 5.0, "load")]]
    got, _ = stepped(spark, tmp_path, rows, "10 minutes")
    found = {(r["state"], r["samples"], r["seen"].replace(tzinfo=timezone.utc)) for r in got.filter("rule = 'high'").collect()}
    assert found == {("firing", 3, at(130)), ("resolved", 3, at(130))}


def test_no_rows(spark, tmp_path):
    assert stepped(spark, tmp_path, [[]])[0].count() == 0

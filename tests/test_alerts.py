import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import duration_text
from tidemark.operators import alerts as A
from tidemark.operators import recovery as R
from tidemark.operators.retention import apply_retention

START = datetime(2024, 1, 1)

# Boundary cases of the lag assessment.
LAG_CASES = [
    ("critical", 10, "OK"), ("critical", 30, "WARN"), ("critical", 50, "WARN"), ("critical", 60, "ALERT"), ("critical", 100, "ALERT"),
    ("standard", 299, "OK"), ("standard", 300, "WARN"), ("standard", 899, "WARN"), ("standard", 900, "ALERT"),
    ("compliance", 9, "OK"), ("compliance", 10, "WARN"), ("compliance", 29, "WARN"), ("compliance", 30, "ALERT"),
    ("best-effort", 3599, "OK"), ("best-effort", 3600, "WARN"), ("best-effort", 14400, "ALERT"), ("unknown", 300, "WARN"), (None, 900, "ALERT"),
]


def test_assess_lag(spark):
    df = spark.createDataFrame([(t, l, w) for t, l, w in LAG_CASES], "tier string, lag_s long, want string")
    assert A.assess_lag(df).filter("status <> want").count() == 0


def test_duration_text(spark):
    df = spark.createDataFrame([(45, "45s"), (125, "2m 5s"), (3661, "1h 1m"), (0, "0s")], "s long, want string")
    assert df.filter(duration_text("s") != F.col("want")).count() == 0


@pytest.mark.parametrize("seed,width", [(1, "5 seconds"), (2, "30 seconds"), (3, "1 hour")])
def test_sustained(spark, seed, width):
    rng = random.Random(seed)
    rows, t = [], {"a": START, "b": START}
    for i in range(400):
        k = rng.choice("ab")
        t[k] += timedelta(seconds=rng.choice([1, 2, 4, 15]))
        rows.append((k, t[k], float(rng.choice([1, 8, 9, 9])), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, value double, seq long").withColumn("metric", F.lit("m"))
    rules = [A.Rule("hot", "m", "gt", 5.0, 6, "warn"), A.Rule("mid", "m", "gt", 8.0, 0, "warn"), A.Rule("band", "m", "gt", 0.0, 2, "warn", ceiling=8.0)]
    rules = A.rules_table(spark, rules) if seed == 2 else rules
    out = A.alert_sustained(df, rules, "k", max_gap="10 seconds", order="seq", width=width)
    got = sorted((r["rule"], r["k"], r["started"], r["last_seen"], r["samples"], r["peak"], r["fired_at"]) for r in out.collect())
    want = []
    for rule, hold, hit in (("hot", 6, lambda v: v > 5), ("mid", 0, lambda v: v > 8), ("band", 2, lambda v: 0 < v <= 8)):
        for key in "ab":
            runs, last = [], None
            for _, ts, v, _ in (r for r in rows if r[0] == key):
                if hit(v):
                    if last is None or not last[1] or ts - last[0] > timedelta(seconds=10):
                        runs.append([])
                    runs[-1].append((ts, v))
                last = (ts, hit(v))
            for run in runs:
                if run[-1][0] - run[0][0] >= timedelta(seconds=hold):
                    want.append((rule, key, run[0][0], run[-1][0], len(run), max(v for _, v in run), run[0][0] + timedelta(seconds=hold)))
    assert got == sorted(want)


def test_auth_bursts(spark):
    """More than ten failures in a minute: the eleventh counts, and the minute's start is open."""
    rows = [("p", START + timedelta(seconds=5 * i), "authentication", "FAILURE") for i in range(13)]
    rows += [("q", START + timedelta(seconds=6 * i), "authentication", "FAILURE") for i in range(20)]
    rows += [("r", START + timedelta(seconds=i), "authentication", "SUCCESS") for i in range(30)]
    df = spark.createDataFrame(rows, "principal string, ts timestamp, event string, result string")
    got = sorted((r["principal"], r["in_window"]) for r in A.auth_bursts(df).collect())
    assert got == [("p", 11), ("p", 12), ("p", 12)]


@pytest.mark.parametrize("width", ["1 minute", "1 hour"])
def test_outside_windows(spark, width):
    rng = random.Random(9)
    ev = [(i, START + timedelta(seconds=rng.randrange(3600))) for i in range(200)] + [(200, None)]
    win = [(s, s + timedelta(seconds=rng.choice([0, 30, 300]))) for s in (START + timedelta(seconds=rng.randrange(3600)) for _ in range(15))]
    win += [(None, START), (START, None), (START + timedelta(hours=2), START), *win[:3]]
    out = A.outside_windows(spark.createDataFrame(ev, "id long, ts timestamp"), spark.createDataFrame(win, "start timestamp, end timestamp"), width=width)
    held = [w for w in win if None not in w]
    assert out.columns == ["id", "ts"]
    assert sorted(r["id"] for r in out.collect()) == [i for i, t in ev if t is None or not any(s <= t < e for s, e in held)]


def test_audit_rules(spark):
    audit = spark.createDataFrame(
        [("1", START, "schema.hard_delete", "User:a", "x", "audit-log", "DENIED"), ("2", START, "schema.hard_delete", "User:b", "x", "t", "OK")],
        "id string, ts timestamp, event string, principal string, operation string, resource string, result string")
    admins = spark.createDataFrame([("User:b",)], "principal string")
    assert [r["id"] for r in A.unauthorised_deletes(audit, admins).collect()] == ["1"]
    assert [r["id"] for r in A.denied_on(audit, "audit-log").collect()] == ["1"]


def test_empty_status_is_synced(spark):
    empty = spark.createDataFrame([], "topic string, tier string, lag_s long, warn_s long, threshold_s long, status string")
    assert R.all_synced(empty).collect()[0]["all_synced"] is True
    assert R.lag_summary(empty).collect()[0]["summary"] == "0 topics OK, 0 WARN, 0 ALERT"


def test_retention_boundaries(spark):
    now = datetime(2024, 1, 8)
    rows = [("critical", datetime(2024, 1, 1), True), ("critical", datetime(2023, 12, 31, 23, 59, 59), False),
            ("best-effort", datetime(2024, 1, 7), True), ("best-effort", datetime(2024, 1, 6), False),
            ("compliance", datetime(2018, 1, 1), True), ("compliance", datetime(2016, 1, 1), False), (None, datetime(2024, 1, 5), True)]
    df = spark.createDataFrame(rows, "tier string, ts timestamp, kept boolean")
    out = apply_retention(df, "ts", "tier", now, compliance_years=7)
    assert out.filter("NOT kept").count() == 0 and out.count() == 4
    assert apply_retention(df, "ts", "tier", now).filter("tier = 'compliance'").count() == 2
    with pytest.raises(ValueError):
        apply_retention(df, "ts", "tier", now, compliance_years=6)

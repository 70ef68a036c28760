"""Rules as expressions: one scan for all of them, equal subtrees once, values against a plain evaluation."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.operators.rules import GraphRule, Math, Over, Series, Holds, alerts_from_samples, evaluated, nodes
from tidemark.plans import PLANS

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
UP = Holds(Series("up", "last", "3 minutes"), "lt", 1.0)
DOWN = Over("sum", UP, ("zone",))
ALL = Over("count", Series("up", "last", "3 minutes"), ("zone",))
RULES = (
    GraphRule("down", DOWN, "gt", 0.0, 60),
    GraphRule("share", Math("/", DOWN, ALL), "ge", 0.5, 120),
    GraphRule("loop", Series("restarts", "increase", "5 minutes", (("zone", "a"),)), "gt", 2.0, 0),
    GraphRule("slow", Over("max", Series("sent", "rate", "5 minutes")), "lt", 1.0, 60),
    GraphRule("gap", Math("-", Over("avg", Series("sent", "rate", "5 minutes")), Over("min", Series("sent", "rate", "5 minutes"))), "gt", 0.1, 60),
    GraphRule("down-again", DOWN, "gt", 1.0, 60),
)


def samples(spark):
    rng, rows = random.Random(2), []
    for zone, task in (("a", 1), ("a", 2), ("b", 1), (None, 3)):
        total = 0
        for i in range(60):
            at = START + timedelta(seconds=30 * i + rng.randrange(20))
            total += rng.randrange(30)
            rows += [("up", zone, task, at, int(rng.random() < 0.6)), ("sent", zone, task, at, total if i % 25 else total // 9), ("noise", zone, task, at, 1)]
            if rng.random() < 0.3:
                rows.append(("restarts", zone, task, at, i // 4))
    return rows, spark.createDataFrame([(*r, "?") for r in rows], "metric string, zone string, task int, ts timestamp, value bigint, node string")


def at_points(rows, metric, take, back):
    out = {}
    for key in {(z, k) for m, z, k, _, _ in rows if m == metric}:
        own = sorted((t, v) for m, z, k, t, v in rows if m == metric and (z, k) == key)
        for i in range(0, 60):
            at = START + timedelta(minutes=i)
            held = [(t, v) for t, v in own if at - timedelta(seconds=back) < t <= at]
            if held:
                grown = sum(b - a if b >= a else b for (_, a), (_, b) in zip(held, held[1:]))
                span = (held[-1][0] - held[0][0]).total_seconds()
                value = held[-1][1] if take == "last" else None if not span else grown if take == "increase" else grown / span
                if value is not None:
                    out[(*key, at)] = float(value)
    return out


def grouped(values, fold):
    out = {}
    for (zone, _, at), v in values.items():
        out.setdefault((zone, at), []).append(v)
    return {k: fold(v) for k, v in out.items()}


def test_values_against_plain(spark):
    rows, df = samples(spark)
    got = {}
    for r in evaluated(df, RULES, ["zone", "task"], "1 minute").collect():
        got.setdefault(r["rule"], {})[(r["zone"], r["task"], r["ts"].replace(tzinfo=timezone.utc))] = r["value"]
    up, sent = at_points(rows, "up", "last", 180), at_points(rows, "sent", "rate", 300)
    down = grouped({k: float(v < 1) for k, v in up.items()}, sum)
    every = grouped(up, len)
    assert got["down"] == got["down-again"] == {(z, None, at): v for (z, at), v in down.items()}
    assert got["share"] == {(z, None, at): down[z, at] / every[z, at] for z, at in every}
    assert got["loop"] == {k: v for k, v in at_points(rows, "restarts", "increase", 300).items() if k[0] == "a"}
    per_time = {}
    for (_, _, at), v in sent.items():
        per_time.setdefault(at, []).append(v)
    assert got["slow"] == {(None, None, at): max(v) for at, v in per_time.items()}
    assert got["gap"] == {(None, None, at): pytest.approx(sum(v) / len(v) - min(v), abs=1e-9) for at, v in per_time.items()}


def test_equal_subtrees_are_one_node():
    assert len(nodes(RULES)) == 11 and nodes(RULES)[DOWN] == 2 and nodes(RULES)[Math("/", DOWN, ALL)] == 3


def test_samples_are_scanned_once(spark):
    for name in ("rule_values_at_steps", "alerts_from_counters"):
        text = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") == 1 and "Join" not in text
        assert "In(event_type" in text


def test_alerts_fire(spark):
    _, df = samples(spark)
    fired = {r["rule"] for r in alerts_from_samples(df, RULES, ["zone", "task"], "1 minute").collect()}
    assert {"down", "share", "loop", "slow"} <= fired
    assert alerts_from_samples(df.limit(0), RULES, ["zone", "task"], "1 minute").count() == 0

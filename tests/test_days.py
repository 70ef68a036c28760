"""Retention over a table by day: equal to the row-wise rule, files of kept days untouched, safe to call again."""

import os
from datetime import datetime, timedelta

import pytest

from tidemark.operators.retention import apply_retention
from tidemark.streaming.days import DayTable

NOW = datetime(2024, 3, 10, 9, 30)
SCHEMA = "id long, ts timestamp, tier string, day_of string"


def data():
    tiers = ["critical", "standard", "best-effort", "compliance", "odd/tier=1", None]
    rows = [(i, NOW - timedelta(hours=i), tiers[i % 6], "x") for i in range(600)]
    return rows + [(1000 + i, None, tier, None) for i, tier in enumerate(tiers)] + [
        (2000, NOW - timedelta(days=7), "critical", "on the limit"), (2001, NOW - timedelta(days=7, milliseconds=1), "critical", "over it")]


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                at = os.path.join(folder, name)
                found[at] = os.stat(at).st_mtime_ns
    return found


@pytest.mark.parametrize("years", [-1, 7])
def test_expire_equals_the_row_rule(spark, tmp_path, years):
    rows = spark.createDataFrame(data(), SCHEMA)
    table = DayTable(f"{tmp_path}/t", "ts", "tier")
    for batch in range(3):
        table(rows.filter(rows.id % 3 == batch), batch)
    table(rows.filter(rows.id % 3 == 1), 1)  # delivered again
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(table.read(spark, rows.schema)) == ids(rows)
    before = files(f"{tmp_path}/t")
    dropped, rewritten = table.expire(spark, rows.schema, NOW, years)
    want = apply_retention(rows, "ts", "tier", NOW, years)
    assert ids(table.read(spark, rows.schema)) == ids(want) and 2000 in ids(want) and 2001 not in ids(want)
    assert dropped > 20 and 3 <= rewritten <= 5  # one day on the edge for each tier that ends
    after = files(f"{tmp_path}/t")
    fresh = {os.path.dirname(os.path.dirname(f)) for f in after if f not in before}
    assert len(fresh) <= rewritten and all(before[f] == at for f, at in after.items() if f in before)
    assert len([f for f in after if f in before]) >= 30
    first = table.expire(spark, rows.schema, NOW, years)
    assert first[0] == 0 and ids(table.read(spark, rows.schema)) == ids(want)
    table(rows.filter(rows.id % 3 == 2), 2)  # an old batch once more, after its days went
    table.expire(spark, rows.schema, NOW, years)
    assert ids(table.read(spark, rows.schema)) == ids(want)


def test_expire_that_failed_half_way(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(data(), SCHEMA)
    table = DayTable(f"{tmp_path}/t", "ts", "tier")
    table(rows, 0)

    moved = []
    move = DayTable._move

    def failing(self, session, source, target):
        move(self, session, source, target)
        moved.append(target)
        if len(moved) == 2:
            raise OSError("lost")

    monkeypatch.setattr(DayTable, "_move", failing)
    with pytest.raises(OSError):
        table.expire(spark, rows.schema, NOW)
    monkeypatch.setattr(DayTable, "_move", move)
    table.expire(spark, rows.schema, NOW)
    want = apply_retention(rows, "ts", "tier", NOW)
    assert sorted(r["id"] for r in table.read(spark, rows.schema).collect()) == sorted(r["id"] for r in want.collect())


def test_no_rows(spark, tmp_path):
    table = DayTable(f"{tmp_path}/t", "ts", "tier")
    assert table.expire(spark, spark.createDataFrame([], SCHEMA).schema, NOW) == (0, 0)

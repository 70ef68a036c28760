"""Physical plans: no cross joins, Python only where user code runs, filters in the scan."""

import pytest

from tidemark.plans import PLANS, Tables

FOLDER = "/root/testdata/sf0.001"
WRITERS = ("sink_plans", "stream_plans")
READERS = sorted(n for n, p in PLANS.items() if p.build.__module__.rsplit(".", 1)[-1] not in WRITERS)


def physical(spark, name: str) -> str:
    return PLANS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", READERS)
def test_plan(spark, name):
    text = physical(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    python = "InPandas" in text or "EvalPython" in text
    assert python == (name == "record_handler")


@pytest.mark.parametrize("name,pushed", [
    ("select_filter", "GreaterThan(value,20.0)"), ("reduce_last_max", "GreaterThan(ts,"), ("replay_from", "GreaterThanOrEqual(ts,"),
    ("label_filters", "StringStartsWith(source,src1)"), ("retention_by_tier", "GreaterThanOrEqual(o_orderdate,"),
])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in physical(spark, name)


@pytest.mark.parametrize("name,exchanges", [
    ("tumbling_1m", 1), ("rate_5m", 1), ("increase_15m", 1), ("compact_latest", 1), ("apply_changes", 1),
    ("reconcile_roundtrip", 1), ("id_difference", 1), ("state_history", 2), ("alerts_sustained", 3), ("assess_lag", 0), ("route_split", 0),
])
def test_shuffles(spark, name, exchanges):
    assert physical(spark, name).count("Exchange hashpartitioning") == exchanges


def test_scan_reads_only_used_columns(spark):
    text = Tables(spark, FOLDER).events.groupBy("event_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in text


@pytest.mark.parametrize("name", ["typed_contract", "decode_payloads"])
def test_text_is_parsed_once(spark, name):
    assert physical(spark, name).count("from_json(") == 1

import pytest

from tidemark.session import fresh_path
from tidemark.streaming.sealed import SealedTable

OLD, NEW = ({"a": bytes([i]) * 32, "b": bytes([i + 1]) * 32} for i in (1, 11))
SCHEMA = "id long, name string, key_id string"


def test_keys_are_wrapped_anew_without_the_rows(spark):
    path = fresh_path(spark, "sealed")
    table = SealedTable(path, ["name"], OLD)
    first = spark.createDataFrame([(1, "x", "a"), (2, None, "b"), (3, "", "a")], SCHEMA)
    table(first, 0)
    table(first, 0)  # delivered again
    stored = lambda: {(r["id"], r["name"]) for r in table.sealed(spark, first.schema).collect()}
    before = stored()
    assert len(before) == 3 and all(v is None or len(v) >= 28 for _, v in before)
    table.rewrap(spark, NEW)
    table.rewrap(spark, NEW)  # nothing is left to do
    table(spark.createDataFrame([(4, "y", "b")], SCHEMA), 1)
    assert before < stored()
    assert {r["generation"] for r in table.keys(spark).filter("batch = 0").collect()} == {1}
    rows = lambda masters, **kw: {tuple(r) for r in table.opened(spark, first.schema, masters, **kw).collect()}
    assert rows(NEW) == {(1, "x", "a"), (2, None, "b"), (3, "", "a"), (4, "y", "b")}
    with pytest.raises(Exception):
        rows(OLD)


def test_unknown_key_id_is_not_written_in_clear(spark):
    with pytest.raises(Exception, match="no data key"):
        SealedTable(fresh_path(spark, "sealed"), ["name"], OLD)(spark.createDataFrame([(1, "x", "c")], SCHEMA), 0)

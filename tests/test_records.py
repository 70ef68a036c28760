"""Changes, errors, privacy, reconciliation, schemas."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators import changes as C
from tidemark.operators import errors as E
from tidemark.operators.joins import match_on
from tidemark.operators.privacy import decrypt_fields, encrypt_fields, master_keys, new_keyring
from tidemark.operators.reconcile import offset_lag, reconcile, with_counters
from tidemark.operators.routing import route, split_routes
from tidemark.operators.windows import amount_stats, tumbling
from tidemark.sources.changes import flatten_change, poll_increment
from tidemark.sources.schemas import pii_fields, schema_from_avsc
from tidemark.sources.topics import decode_values

START = datetime(2024, 1, 1)


def test_compact_and_tombstones(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y"), ("b", 1, "z")], "k string, v int, body string")
    assert [tuple(r) for r in C.compact(df, "k", "v", F.col("body").isNull()).collect()] == [("b", 2, "y")]
    assert C.compact(df, "k", "v").count() == 2


def test_apply_changes_ignores_older(spark):
    target = spark.createDataFrame([("a", 5, "new"), ("b", 1, "old"), ("c", 1, "gone")], "k string, v int, body string")
    changes = spark.createDataFrame([("a", 4, "stale", False), ("b", 2, "fresh", False), ("c", 1, None, True), ("d", 1, "born", False)], "k string, v int, body string, deleted boolean")
    assert sorted(tuple(r) for r in C.apply_changes(target, changes, "k", "v").collect()) == [("a", 5, "new"), ("b", 2, "fresh"), ("d", 1, "born")]


def test_resolved_of_several_streams(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "updated long")
    marks = spark.createDataFrame([("x", 7), ("x", 9), ("y", 4)], "s string, resolved long")
    assert C.release_resolved(rows, marks, stream="s").count() == 5
    assert C.release_resolved(rows, marks).count() == 10
    assert C.release_resolved(rows, marks.filter("s = 'z'")).count() == 0


def test_resolved_holds_feeds_without_a_mark(spark):
    rows = spark.createDataFrame([(i, s) for i in range(10) for s in "xyz"], "updated long, s string")
    marks = spark.createDataFrame([("x", 7), ("x", 9), ("y", 4)], "s string, resolved long")
    assert C.release_resolved(rows, marks, stream="s").count() == 0
    assert C.release_resolved(rows.filter("s <> 'z'"), marks, stream="s").count() == 10
    own = C.release_resolved(rows, marks, stream="s", rule="feed").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in own} == {"x": 10, "y": 5}
    with pytest.raises(ValueError):
        C.release_resolved(rows, marks, stream="s", rule="fastest")


def test_poll_keeps_rows_that_arrive_after_the_position(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "ts timestamp, id long"
    spark.createDataFrame([(at, 1), (at, 2), (None, 3)], schema).write.parquet(f"{tmp_path}/t")
    table = spark.read.schema(schema).parquet(f"{tmp_path}/t")
    first, position = poll_increment(table, "ts", "id")
    spark.createDataFrame([(at, 4)], schema).write.mode("append").parquet(f"{tmp_path}/t")
    table = spark.read.schema(schema).parquet(f"{tmp_path}/t")
    last = position.collect()[0]
    assert sorted(r["id"] for r in first.collect()) == [1, 2, 3] and last["id"] == 2
    assert [r["id"] for r in poll_increment(table, "ts", "id", last)[0].collect()] == [4]


def test_dead_letters_are_counted_once(spark):
    from tidemark.operators.errors import dlq_increase

    start = datetime(2024, 1, 1)
    rows = [("a.dlq", start + timedelta(hours=i), i) for i in range(24)] + [("a", start, 5)]
    got = dlq_increase(spark.createDataFrame(rows, "topic string, ts timestamp, value long"), r".*\.dlq", "1 day", "1 day").collect()
    assert [(r["samples"], r["records"], r["per_second"]) for r in got] == [(23, 23, 23 / 86400)]


def test_flatten_change_variants(spark):
    schema = "op string, before struct<k:int>, after struct<k:int>"
    df = spark.createDataFrame([("c", None, (1,)), ("u", (1,), (2,)), ("d", (2,), None), (None, None, None)], schema)
    kept = sorted(((r["k"], r["deleted"]) for r in flatten_change(df).collect()), key=str)
    assert kept == sorted([(1, False), (2, False), (2, True), (None, None)], key=str)
    assert flatten_change(df, deletes="drop", tombstones="drop").count() == 2


def test_poll_walks_without_gap_or_repeat(spark):
    rows = [(datetime(2024, 1, 1 + i // 3), i) for i in range(12)]
    table = spark.createDataFrame(rows, "ts timestamp, id long")
    seen, last = [], None
    for upto in (5, 5, 9, 12):
        now = table.filter(F.col("id") < upto)
        batch, position = poll_increment(now, "ts", "id", last)
        seen += [r["id"] for r in batch.collect()]
        newest = position.collect()[0]
        last = newest if newest["ts"] is not None else last
    assert sorted(seen) == list(range(12)) and len(seen) == 12


ERROR_CASES = [
    ("_VALUE_SERIALIZATION", "schema incompatible", "SERIALIZATION"), ("CLUSTER_AUTHORIZATION_FAILED", "", "AUTH_DENIED"),
    ("_MSG_TIMED_OUT", "", "BROKER_TIMEOUT"), ("X", "Schema being registered is INCOMPATIBLE", "SCHEMA_INCOMPATIBLE"),
    ("X", "schema compatibility level", "SCHEMA_INCOMPATIBLE"), ("X", "incompatible", "UNKNOWN"), (None, None, "UNKNOWN"),
]


def test_error_categories(spark):
    df = spark.createDataFrame(ERROR_CASES, "code string, message string, want string")
    assert df.filter(E.classify_error("code", "message") != F.col("want")).count() == 0


def test_retry_plan(spark):
    df = spark.createDataFrame([("_TIMED_OUT", n) for n in range(5)] + [("_KEY_SERIALIZATION", 0), (None, 0)], "code string, n int")
    got = [tuple(r["p"]) for r in df.select(E.plan_retry("code", "n").alias("p")).collect()]
    assert got == [("retry", 1.0), ("retry", 2.0), ("retry", 4.0), ("dead_letter", None), ("dead_letter", None), ("dead_letter", None), ("retry", 1.0)]


def test_envelope_cuts_message(spark):
    df = spark.createDataFrame([("c", "m" * 3000, START, 2)], "code string, message string, at timestamp, n int")
    row = E.dlq_envelope(df, F.lit("t"), F.col("code"), F.col("message"), F.col("at"), F.col("n"), "app").collect()[0]
    assert row["dlq_topic"] == "t.dlq" and len(row["headers"]["dlq.error.message"]) == 1024
    assert row["headers"]["dlq.timestamp"] == "2024-01-01T00:00:00.000000+00:00" and row["headers"]["dlq.producer.client.id"] == "app-dlq"


def test_split_keeps_tombstones_and_bad_rows(spark):
    df = spark.createDataFrame([("1", '{"k": 1}'), ("2", '{"k": "x"}'), ("3", "nope"), ("4", None), ("5", "{}")], "id string, value string")
    good, bad = E.split_decodable(df, T.StructType([T.StructField("k", T.IntegerType())]))
    assert sorted(r["id"] for r in good.collect()) == ["1", "4", "5"] and sorted(r["id"] for r in bad.collect()) == ["2", "3"]


def test_handler_failures_are_rows(spark):
    def handler(key, value):
        if value is None:
            raise KeyError(key)

    out = E.foreach_record(spark.createDataFrame([("a", "x"), ("b", None)], "key string, value string"), handler)
    assert {r["key"]: (r["handled"], r["error"]) for r in out.collect()} == {"a": (True, None), "b": (False, "KeyError: 'b'")}


AVSC = """{"type": "record", "name": "T", "namespace": "org.example.a.b.v1", "fields": [
 {"name": "id", "type": "string", "doc": "PII"}, {"name": "note", "type": ["null", "string"], "default": null},
 {"name": "amount", "type": {"type": "bytes", "logicalType": "decimal", "precision": 15, "scale": 2}},
 {"name": "currency", "type": "string", "default": "USD"}, {"name": "day", "type": {"type": "int", "logicalType": "date"}},
 {"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["A"]}},
 {"name": "inner", "type": {"type": "record", "name": "I", "fields": [{"name": "n", "type": "long"}]}}]}"""


def test_schema_documents(spark):
    schema = schema_from_avsc(AVSC)
    assert pii_fields(schema) == ["id"] and schema["note"].nullable and schema["amount"].dataType == T.DecimalType(15, 2)
    assert schema["kind"].metadata["symbols"] == ["A"] and schema["inner"].dataType["n"].dataType == T.LongType()
    body = '{"id":"1","amount":1.25,"day":"2024-02-03","tags":["x"],"kind":"A","inner":{"n":4}}'
    good, bad = decode_values(spark.createDataFrame([(body,)], "value string"), schema)
    row = good.collect()[0]
    assert (row["amount"], row["currency"], row["day"], row["inner"]["n"]) == (Decimal("1.25"), "USD", date(2024, 2, 3), 4)
    assert bad.count() == 0
    with pytest.raises(ValueError):
        schema_from_avsc('{"type": "enum"}')


def test_missing_key_fails(spark):
    df = spark.createDataFrame([("a", "secret"), ("b", None)], "key_id string, name string")
    ring = new_keyring(spark, {"a": b"k" * 32, "b": b"j" * 32})
    sealed = encrypt_fields(df, ["name"], ring)
    assert sealed.filter("cast(name as string) = 'secret'").count() == 0
    opened = decrypt_fields(sealed, ["name"], master_keys(spark, {"a": b"k" * 32, "b": b"j" * 32}))
    assert {r["key_id"]: r["name"] for r in opened.collect()} == {"a": "secret", "b": None}
    with pytest.raises(Exception, match="no master key"):
        decrypt_fields(sealed, ["name"], master_keys(spark, {"b": b"j" * 32})).collect()
    with pytest.raises(Exception, match="no data key"):
        encrypt_fields(df.withColumn("key_id", F.lit("zz")), ["name"], ring).collect()
    wrong = decrypt_fields(sealed, ["name"], master_keys(spark, {"a": b"x" * 32, "b": b"j" * 32}), strict=False)
    assert {r["key_id"]: (r["name"], r["decrypt_failed"]) for r in wrong.collect()} == {"a": (None, True), "b": (None, False)}


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "p", "q"), (4, "m", "m"), (4, "n", "n"), (6, "d", "d")], "k int, u string, v string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "n", "n"), (4, "m", "m"), (5, "z", "z"), (6, "d", "d"), (6, "d", "d")], "k int, u string, v string")
    assert {r["k"]: r["state"] for r in reconcile(a, b, "k").collect()} == {1: "same", 2: "changed", 3: "missing", 4: "same", 5: "extra", 6: "changed"}


def test_offsets_and_counters(spark):
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 5)], "topic string, partition int, end_offset long")
    done = spark.createDataFrame([("t", 0, "g", 10), ("t", 0, "g", 7)], "topic string, partition int, group string, committed long")
    assert {r["partition"]: (r["lag"], r["drained"]) for r in offset_lag(ends, done).collect()} == {0: (0, True), 1: (5, False)}
    watched, seen = with_counters(spark.range(10).withColumn("bad", F.col("id") > 7), "counted", failed="bad")
    assert watched.count() == 10 and seen.get == {"consumed": 10, "errors": 2, "dead_lettered": 0}


def test_routes_and_null_scores(spark):
    df = spark.createDataFrame([(1, 90.0), (2, 84.9), (3, None), (4, 85.0)], "id int, score double")
    routes = {"high": F.col("score") >= 85, "low": F.col("score") < 85}
    assert sorted((r["id"], r["route"]) for r in route(df, routes).collect()) == [(1, "high"), (2, "low"), (4, "high")]
    assert {n: d.count() for n, d in split_routes(df, routes).items()} == {"high": 2, "low": 1}


def test_match_on_refuses_duplicates(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([("x", 1)], "k string, b int")
    with pytest.raises(Exception, match="share a label set"):
        match_on(a, b, "k").collect()


def test_window_average_rounds_half_up_once(spark):
    df = spark.createDataFrame([(START, Decimal("0.01")), (START, Decimal("0.02")), (START, None)], "ts timestamp, value decimal(15,2)")
    row = tumbling(df, "ts", "1 minute", amount_stats("value")).collect()[0]
    assert (row["transaction_count"], row["total_amount"], row["avg_amount"]) == (3, Decimal("0.03"), Decimal("0.02"))

"""Streams against their batch form, with disorder, late rows, duplicates and restarts."""

import random
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.changes import compact, dedupe_versions, release_resolved
from tidemark.operators.joins import asof_join
from tidemark.operators.windows import amount_stats, tumbling, with_event_time
from tidemark.sources.topics import kafka_options, read_topic
from tidemark.streaming import sinks, tables
from tidemark.streaming.late import LateSplit
from tidemark.streaming.run import drained, run_stream, run_to_parquet, use_rocksdb
from tidemark.streaming.stateful import asof_join_stream, release_resolved_stream

START = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, value double"


def rows(seed=1, n=240, jitter=4):
    """Rows in rough time order, so that nothing is later than the watermark allows."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "b"]), START + timedelta(seconds=i * 2 + rng.randrange(jitter)), float(rng.randrange(50))) for i in range(n)]


def put(spark, path, data, files=4):
    """Write the rows as files in time order, one micro-batch each."""
    step = -(-len(data) // files)
    for i in range(files):
        spark.createDataFrame(data[i * step:(i + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")


def stream(spark, path, delay="20 seconds"):
    raw = read_topic(spark, path, SCHEMA + ", part int", max_per_batch=1)
    return with_event_time(raw.drop("part"), "ts", delay)


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_tumbling_stream_equals_batch(spark, tmp_path):
    data = rows()
    closing = [(9999, "a", START + timedelta(days=1), 0.0)]
    put(spark, f"{tmp_path}/in", data)
    put(spark, f"{tmp_path}/in2", closing, 1)
    spark.read.parquet(f"{tmp_path}/in2").write.mode("append").partitionBy("part").parquet(f"{tmp_path}/in")
    out = tumbling(stream(spark, f"{tmp_path}/in"), "ts", "1 minute", amount_stats("value"))
    drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp"))
    batch = tumbling(spark.createDataFrame(data, SCHEMA), "ts", "1 minute", amount_stats("value"))
    assert same(spark.read.parquet(f"{tmp_path}/out"), batch)


def test_late_rows_are_dropped_and_shown(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, "a", START, 1.0)], 1)
    for i, (ident, minute) in enumerate([(2, 30), (3, 31), (4, 1), (5, 40)], 1):
        spark.createDataFrame([(ident, "a", START + timedelta(minutes=minute), 1.0)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={i:03d}")
    use_rocksdb(spark)
    split = LateSplit(f"{tmp_path}/split", "ts", "5 seconds")
    drained(run_stream(stream(spark, f"{tmp_path}/in"), split, f"{tmp_path}/cp1"))
    want = {1: False, 2: False, 3: False, 4: True, 5: False}
    rows = lambda: split.read(spark, stream(spark, f"{tmp_path}/in").schema)
    assert {r["id"]: r["late"] for r in rows().collect()} == want
    again = spark.createDataFrame([(5, "a", START + timedelta(minutes=40), 1.0)], SCHEMA)
    split(again, 4)  # delivered again: the same mark, the same folders
    assert sorted((r["id"], r["late"]) for r in rows().collect()) == sorted(want.items())
    more = [(6, "a", START + timedelta(minutes=39), 1.0), (7, "a", None, 1.0), (8, "b", START + timedelta(minutes=39, seconds=55), 1.0)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=900")
    drained(run_stream(stream(spark, f"{tmp_path}/in"), split, f"{tmp_path}/cp1"))  # a restart goes on from the mark
    assert {r["id"]: r["late"] for r in rows().collect()} == want | {6: True, 7: False, 8: False}
    counted = tumbling(stream(spark, f"{tmp_path}/in"), "ts", "1 minute", [F.count("*").alias("n")])
    drained(run_to_parquet(counted, f"{tmp_path}/out", f"{tmp_path}/cp2"))
    starts = {r["window_start"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert START in starts and START + timedelta(minutes=1) not in starts


@pytest.mark.parametrize("salts", [1, 3])
def test_asof_stream_equals_batch_over_a_restart(spark, tmp_path, salts):
    use_rocksdb(spark)
    left, right = rows(2), rows(3)
    end = [(7777, "a", START + timedelta(days=1), 0.0)]

    def joined():
        l = stream(spark, f"{tmp_path}/l")
        r = stream(spark, f"{tmp_path}/r").select("k", F.col("ts").alias("since"), F.col("id").alias("ver"), F.col("value").alias("rating"))
        return asof_join_stream(l, r, "k", "ts", "since", order="ver", salts=salts)

    put(spark, f"{tmp_path}/l", left[:120], 2)
    put(spark, f"{tmp_path}/r", right[:120], 2)
    drained(run_to_parquet(joined(), f"{tmp_path}/out", f"{tmp_path}/cp"))
    first = spark.read.parquet(f"{tmp_path}/out").count()
    for name, more in (("l", left[120:] + end), ("r", right[120:] + end)):
        spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/part=010")
    drained(run_to_parquet(joined(), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out")
    r = spark.createDataFrame(right, SCHEMA).select("k", F.col("ts").alias("since"), F.col("id").alias("ver"), F.col("value").alias("rating"))
    want = asof_join(spark.createDataFrame(left, SCHEMA), r, "k", "ts", "since", order="ver")
    assert 0 < first < got.count() and same(got, want)


def state(spark, path, name):
    return spark.read.format("statestore").option("path", path).option("stateVarName", name).load()


def test_asof_state_is_sliced_and_typed(spark, tmp_path):
    """Quiet keys keep one passed version, slices that are not due are not written again, all types come back."""
    use_rocksdb(spark)
    schema = "k string, ts timestamp, big long, money decimal(20,2), flag boolean, day date, raw binary, tags array<string>, at timestamp, nest struct<x:int,y:timestamp>"

    def row(k, s, i):
        t = START + timedelta(seconds=s)
        if i % 5 == 4:
            return (k, t) + (None,) * 8
        return (k, t, 2**60 + i, Decimal(i) / 4, i % 2 == 0, date(2024, 1, 1 + i % 20), bytes([i]), ["a", None], t + timedelta(microseconds=i), (i, t))

    versions = [row(k, s, s // 10) for s in range(0, 600, 10) for k in ("quiet", "x")]
    lefts = [("x", START + timedelta(seconds=s), s) for s in (5, 30, 310, 595)]
    spark.createDataFrame(versions, schema).withColumn("part", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame(lefts, "k string, ts timestamp, n int").coalesce(1).write.parquet(f"{tmp_path}/l")

    def run():
        l = with_event_time(spark.readStream.schema("k string, ts timestamp, n int").parquet(f"{tmp_path}/l"), "ts", "5 seconds")
        r = with_event_time(spark.readStream.schema(schema).parquet(f"{tmp_path}/r"), "ts", "5 seconds").withColumnRenamed("ts", "since")
        drained(run_to_parquet(asof_join_stream(l, r, "k", "ts", "since", order="big", salts=1, width="1 minute"), f"{tmp_path}/out", f"{tmp_path}/cp"))

    def chunks():
        held = state(spark, f"{tmp_path}/cp", "chunks").select("key.k", "user_map_key.slice", F.explode("user_map_value.right").alias("v"))
        return held.filter(F.col("k") == '["quiet"]').select("slice", "v.us").collect()

    run()
    mark = START + timedelta(seconds=585)
    passed = lambda us: datetime.fromtimestamp(us / 1e6) < mark
    assert {r["slice"] for r in chunks()} == {r["us"] // 60_000_000 for r in chunks()}
    assert len({r["slice"] for r in chunks()}) == 1  # nine slices are over, the tenth is still open
    assert state(spark, f"{tmp_path}/cp", "newest").filter(F.col("key.k") == '["quiet"]').count() == 1
    for part in ("l", "r"):
        kind = "k string, ts timestamp, n int" if part == "l" else schema
        end = [("z", START + timedelta(hours=1), 0)] if part == "l" else [row("z", 3600, 0)]
        spark.createDataFrame(end, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{part}")
    run()
    assert not [r for r in chunks() if passed(r["us"])] and not chunks()
    assert [datetime.fromtimestamp(r["us"] / 1e6) for r in state(spark, f"{tmp_path}/cp", "newest").filter(F.col("key.k") == '["quiet"]').select("value.us").collect()] == [START + timedelta(seconds=590)]
    right = spark.createDataFrame(versions, schema).withColumnRenamed("ts", "since")
    want = asof_join(spark.createDataFrame(lefts, "k string, ts timestamp, n int"), right, "k", "ts", "since", order="big")
    assert same(spark.read.schema(want.schema).parquet(f"{tmp_path}/out"), want) and want.count() == 4


def test_slowest_feed_on_a_stream_equals_batch(spark, tmp_path):
    use_rocksdb(spark)
    data = rows(11)
    marks = [(i, k, START + timedelta(seconds=s), 0.0) for i, (k, s) in enumerate(
        [("hot", 100), ("a", 50), ("hot", 300), ("other", 10), ("hot", 200), ("b", 150), ("a", 400), ("b", 290)])]
    put(spark, f"{tmp_path}/in", data)
    rename = lambda df: df.select("k", F.col("ts").alias("resolved"))
    done = []
    for part, given in enumerate((marks[:5], marks[5:6], marks[6:])):
        spark.createDataFrame(given, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/marks/part={part:03d}")
        out = release_resolved_stream(
            stream(spark, f"{tmp_path}/in"), rename(stream(spark, f"{tmp_path}/marks")), "ts", "resolved", "k", 3, "slowest", ["hot", "a", "b"], "1 minute")
        drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp"))
        seen = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")
        named = [m for m in marks if m[1] != "other"][: (4, 5, 8)[part]]
        want = release_resolved(spark.createDataFrame(data, SCHEMA), rename(spark.createDataFrame(named, SCHEMA)), "ts", "resolved", "k")
        assert same(seen, want)
        done.append(seen.count())
    assert done[0] == 0 < done[1] < done[2]  # nothing before all three feeds have spoken
    with pytest.raises(ValueError):
        release_resolved_stream(out, out, "ts", "resolved", "k", rule="slowest")


def test_resolved_gate_stream(spark, tmp_path):
    use_rocksdb(spark)
    data = rows(4)
    put(spark, f"{tmp_path}/in", data)
    marks = [(i, k, START + timedelta(seconds=s), 0.0) for i, (k, s) in enumerate([("hot", 100), ("a", 50), ("hot", 300), ("hot", 200)])]
    put(spark, f"{tmp_path}/marks", marks)
    resolved = stream(spark, f"{tmp_path}/marks").select("k", F.col("ts").alias("resolved"))
    out = release_resolved_stream(stream(spark, f"{tmp_path}/in"), resolved, "ts", "resolved", "k", salts=3)
    drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp"))
    limit = {"hot": START + timedelta(seconds=300), "a": START + timedelta(seconds=50)}
    want = sorted(r[0] for r in data if r[1] in limit and r[2] <= limit[r[1]])
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_dedupe_stream(spark, tmp_path):
    data = rows(5, 100)
    twice = sorted(data + random.Random(1).sample(data, 60), key=lambda r: r[2])
    put(spark, f"{tmp_path}/in", twice)
    drained(run_to_parquet(dedupe_versions(stream(spark, f"{tmp_path}/in"), "id", "ts"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert same(spark.read.parquet(f"{tmp_path}/out"), spark.createDataFrame(data, SCHEMA))


def test_upserts_from_a_restarted_stream(spark, tmp_path):
    data = rows(6)
    table = tables.KeyedTable(f"{tmp_path}/table", "k", ["ts", "id"], "gone")

    def run():
        marked = stream(spark, f"{tmp_path}/in").withColumn("gone", F.col("value") > 45)
        drained(run_stream(marked, table.apply, f"{tmp_path}/cp"))

    put(spark, f"{tmp_path}/in", data[:150], 2)
    run()
    table.fold(spark, 1)
    spark.createDataFrame(data[150:], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part=010")
    run()
    # Micro-batches follow the files, and files follow time up to the jitter inside them.
    want = {}
    for part in (data[:75], data[75:150], data[150:]):
        for r in sorted(part, key=lambda r: (r[2], r[0])):
            want[r[1]] = r
    assert {r["k"]: r["id"] for r in table.read(spark).collect()} == {k: r[0] for k, r in want.items() if not r[3] > 45}


def docs(spark, data):
    return spark.createDataFrame(data, "k string, seq long, ts timestamp, a string, b string, gone boolean")


def at(s):
    return START + timedelta(seconds=s)


def test_document_strategies(spark, tmp_path):
    first = docs(spark, [("x", 1, at(1), "a1", "b1", False), ("x", 2, at(2), "a2", None, False), ("y", 3, at(3), "a3", "b3", False), ("z", 4, at(4), "a4", "b4", False)])
    second = docs(spark, [("x", 5, at(5), None, "b5", False), ("y", 6, at(6), None, None, True), ("z", 7, at(7), None, None, True), ("z", 8, at(8), None, "b8", False)])
    want = {
        "update": {"x": ("a2", "b5", at(1), at(5)), "z": (None, "b8", at(8), at(8))},
        "replace": {"x": (None, "b5", at(1), at(5)), "z": (None, "b8", at(8), at(8))},
        "delete": {},
    }
    for strategy, result in want.items():
        table = tables.DocumentTable(f"{tmp_path}/{strategy}", "k", "seq", "ts", "gone", strategy)
        for batch_id, batch in enumerate([first, second, second]):
            table.apply(batch, min(batch_id, 1))
        for fold in (None, 0, 1, 0):
            if fold is not None:
                table.fold(spark, fold)
            got = {r["k"]: (r["a"], r["b"], r["inserted_ts"], r["modified_ts"]) for r in table.read(spark).collect()}
            assert got == result, (strategy, fold)


def test_keyed_table_folds_at_any_batch(spark, tmp_path):
    """Folding an early batch late neither loses nor revives rows."""
    rng = random.Random(3)
    table = tables.KeyedTable(f"{tmp_path}/t", "k", "id", "gone")
    state = {}
    for batch_id in range(4):
        batch = [(rng.choice("abcdef"), batch_id * 10 + i, rng.random() < 0.3) for i in range(6)]
        table.apply(spark.createDataFrame(batch, "k string, id long, gone boolean"), batch_id)
        for k, i, gone in batch:
            state[k] = None if gone else i
    want = {k: i for k, i in state.items() if i is not None}
    for fold in (None, 1, 2, 0, 3):
        if fold is not None:
            table.fold(spark, fold)
        assert {r["k"]: r["id"] for r in table.read(spark).collect()} == want, fold


def test_schematized_table_takes_each_offset_once(spark, tmp_path):
    table = tables.SchematizedTable(f"{tmp_path}/t", "ch", "off")
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "ch string, off long, v string")
    b = spark.createDataFrame([("p", 2, "y", 7), ("p", 3, "w", 8), ("q", 2, "u", 9), ("q", 2, "u", 9)], "ch string, off long, v string, extra int")
    for batch_id, batch in ((0, a), (0, a), (1, b), (1, b), (2, a)):
        table.apply(batch, batch_id)
    got = sorted((r["ch"], r["off"], r["v"], r["extra"]) for r in table.read(spark).collect())
    assert got == [("p", 1, "x", None), ("p", 2, "y", None), ("p", 3, "w", 8), ("q", 1, "z", None), ("q", 2, "u", 9)]


def test_key_values_expire(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("b", at(0), 3)], "k string, ts timestamp, v int")
    entries = tables.to_key_value(df, "k", "p:", "ts", 60, ["ts"])
    assert sorted((r["key"], r["expires_at"]) for r in entries.collect()) == [("p:a", at(65)), ("p:b", at(60))]
    assert tables.live_entries(entries, F.lit(at(62))).count() == 1
    forever = tables.to_key_value(df, "k", "p:", "ts", None)
    assert tables.live_entries(forever, F.lit(at(10**6))).count() == 2


def test_dead_letters_and_routes(spark, tmp_path):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "bad")], "id int, value string")
    write = sinks.with_dead_letters(T.StructType([T.StructField("k", T.IntegerType())]), "value", f"{tmp_path}/g", f"{tmp_path}/d", "database", "orders")
    write(df, 0)
    write(df, 0)
    assert [(r["id"], r["k"]) for r in tables.read_batches(spark, f"{tmp_path}/g").collect()] == [(1, 1)]
    dead = tables.read_batches(spark, f"{tmp_path}/d").collect()
    assert [(r["id"], r["dlq_topic"], r["headers"]["error.type"]) for r in dead] == [(2, "database.dlq.orders", "SERIALIZATION")]
    sinks.many_outputs({"x": F.col("id") > 0, "y": F.col("id") > 1}, f"{tmp_path}/r")(df, 0)
    assert sorted((r["id"], r["route"]) for r in tables.read_batches(spark, f"{tmp_path}/r").collect()) == [(1, "x"), (2, "x"), (2, "y")]


def test_streaming_compaction_equals_batch(spark, tmp_path):
    """The batch operator also runs on a stream, in complete mode."""
    put(spark, f"{tmp_path}/in", rows(7))
    query = compact(stream(spark, f"{tmp_path}/in"), "k", ["ts", "id"]).writeStream.outputMode("complete").format("memory").queryName("compacted")
    drained(query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert same(spark.table("compacted"), compact(spark.createDataFrame(rows(7), SCHEMA), "k", ["ts", "id"]))


def test_topic_options(spark, tmp_path):
    assert kafka_options("h:1", topic="t", start="earliest", max_per_batch=10) == {
        "kafka.bootstrap.servers": "h:1", "startingOffsets": "earliest", "subscribe": "t", "maxOffsetsPerTrigger": "10"}
    assert kafka_options("h:1", pattern="a.*")["subscribePattern"] == "a.*"
    with pytest.raises(ValueError):
        kafka_options("h:1")
    put(spark, f"{tmp_path}/in", rows(8, 10), 1)
    with pytest.raises(ValueError):
        read_topic(spark, f"{tmp_path}/in", SCHEMA, start="latest")
    late = read_topic(spark, f"{tmp_path}/in", SCHEMA + ", part int", start=datetime.now(timezone.utc))
    put(spark, f"{tmp_path}/in", [(99, "z", START, 1.0)], 1)
    drained(run_to_parquet(late, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert [r["id"] for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()] == [99]

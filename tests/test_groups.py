"""Stream operators whose keys share state in groups: the same rows as the batch form, few rows of state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streams import SCHEMA, START, put, rows, same, state, stream
from tidemark.operators.changes import release_resolved
from tidemark.operators.joins import asof_join
from tidemark.streaming.run import drained, run_to_parquet, use_rocksdb
from tidemark.streaming.stateful import asof_join_stream, release_resolved_stream


def many(seed):
    """More keys than groups, and numbers that a double does not hold."""
    return [(2**60 + i, f"{k}{i % 7}", ts, v) for i, k, ts, v in rows(seed)]


def versions(df):
    return df.select("k", F.col("ts").alias("since"), F.col("id").alias("ver"), F.col("value").alias("rating"))


def test_asof_in_groups_equals_batch_over_a_restart(spark, tmp_path):
    use_rocksdb(spark)
    left, right = many(2), many(3)
    end = [(7777, "a0", START + timedelta(days=1), 0.0)]

    def run():
        out = asof_join_stream(stream(spark, f"{tmp_path}/l"), versions(stream(spark, f"{tmp_path}/r")), "k", "ts", "since", order="ver", salts=2, width="1 minute", groups=3)
        drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp"))
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")

    put(spark, f"{tmp_path}/l", left[:120], 2)
    put(spark, f"{tmp_path}/r", right[:120], 2)
    first = run().count()
    assert 0 < state(spark, f"{tmp_path}/cp", "newest").count() <= 6
    for name, more in (("l", left[120:] + end), ("r", right[120:] + end)):
        spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/part=010")
    got = run()
    want = asof_join(spark.createDataFrame(left, SCHEMA), versions(spark.createDataFrame(right, SCHEMA)), "k", "ts", "since", order="ver")
    assert 0 < first < got.count() and same(got, want)
    assert state(spark, f"{tmp_path}/cp", "slices").count() <= 6


@pytest.mark.parametrize("rule", ["feed", "slowest"])
def test_gate_in_groups_equals_batch_over_restarts(spark, tmp_path, rule):
    use_rocksdb(spark)
    data = many(4)
    feeds = sorted({r[1] for r in data})
    marks = [(i, k, START + timedelta(seconds=100 + 10 * i), 0.0) for i, k in enumerate(feeds)]
    marks += [(i, k, START + timedelta(seconds=(50, 400)[i % 2]), 0.0) for i, k in enumerate(feeds)]
    rename = lambda df: df.select("k", F.col("ts").alias("resolved"))
    put(spark, f"{tmp_path}/in", data, 3)
    done = []
    for part, upto in enumerate((len(feeds), len(marks))):
        spark.createDataFrame(marks[len(feeds) * part:upto], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/marks/part={part:03d}")
        named = feeds if rule == "slowest" else ()
        out = release_resolved_stream(
            stream(spark, f"{tmp_path}/in"), rename(stream(spark, f"{tmp_path}/marks")), "ts", "resolved", "k", 2, rule, named, "1 minute", groups=3)
        drained(run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/cp"))
        seen = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")
        if rule == "slowest":
            want = release_resolved(spark.createDataFrame(data, SCHEMA), rename(spark.createDataFrame(marks[:upto], SCHEMA)), "ts", "resolved", "k")
        else:
            newest = {}
            for _, k, ts, _ in marks[:upto]:
                newest[k] = max(newest.get(k, datetime.min), ts)
            want = spark.createDataFrame([r for r in data if r[1] in newest and r[2] <= newest[r[1]]], SCHEMA)
        assert same(seen, want)
        done.append(seen.count())
        assert rule == "slowest" or state(spark, f"{tmp_path}/cp", "marks").count() <= 6
    assert 0 < done[0] <= done[1] < len(data)

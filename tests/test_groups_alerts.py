"""Sustained alerts whose series share state in groups: the same rows as with state for each series."""

from pyspark.sql import functions as F

from tests.test_stream_alerts import RULES, SCHEMA, parts
from tidemark.operators.windows import with_event_time
from tidemark.streaming.alerts import alert_sustained_stream
from tidemark.streaming.run import drained, run_to_parquet, use_rocksdb


def test_groups_equal_single_series_over_restarts(spark, tmp_path):
    use_rocksdb(spark)
    for part in parts():
        late = part[:5] + [(*part[0][:2], None, *part[0][3:])]
        spark.createDataFrame(part + late, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        seen = {}
        for groups in (None, 3):
            raw = with_event_time(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts", "5 seconds")
            out = alert_sustained_stream(raw, RULES, ["host", "zone"], max_gap="1 minute", order="seq", groups=groups)
            drained(run_to_parquet(out, f"{tmp_path}/out{groups}", f"{tmp_path}/cp{groups}"))
            seen[groups] = sorted(map(repr, spark.read.schema(out.schema).parquet(f"{tmp_path}/out{groups}").collect()))
        assert seen[3] == seen[None] and seen[3]
        held = spark.read.format("statestore").option("path", f"{tmp_path}/cp3").option("stateVarName", "runs").load()
        assert 0 < held.select(F.col("key.k")).count() <= 3
    assert len(seen[3]) > 40

"""Queries that write through a sink and return what it holds afterwards."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.plans.error_plans import PAYLOAD, _PAYLOADS, payloads
from tidemark.plans.join_plans import order_tier
from tidemark.plans.registry import plan
from tidemark.plans.stream_plans import event_stream, in_thirds
from tidemark.functions import tier_value
from tidemark.functions.units import instant
from tidemark.session import fresh_path
from tidemark.streaming import sinks, tables
from tidemark.streaming.run import drained


@plan("write_topic", "SNK-1", """
SELECT 'bank.events' AS topic, CAST(event_id AS VARCHAR) AS key, user_id, event_type, value FROM events
""")
def _(t):
    root = fresh_path(t.spark, "topic")
    rows = event_stream(t).select("event_id", "user_id", "event_type", "value")
    drained(sinks.write_topic(rows, "bank.events", "event_id", f"{root}/out", f"{root}/checkpoint"))
    records = t.spark.read.parquet(f"{root}/out")
    body = F.from_json("value", "user_id long, event_type string, value double")
    return records.select("topic", "key", body.alias("v")).select("topic", "key", "v.*")


@plan("upsert_table", "SNK-2 CDC-5", """
SELECT * FROM (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
  max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1) WHERE o_orderstatus <> 'F'
""")
def _(t):
    table = tables.KeyedTable(fresh_path(t.spark, "upsert"), "o_custkey", ["o_orderdate", "o_orderkey"], "gone")
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate").withColumn("gone", F.col("o_orderstatus") == "F")
    for i, batch in enumerate(in_thirds(rows, "o_orderdate")):
        table.apply(batch, i)
        table.apply(batch, i)  # a repeated delivery changes nothing
        if i == 1:
            table.fold(t.spark, i)
    return table.read(t.spark)


@plan("upsert_documents", "SNK-3", """
WITH a AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM events),
l AS (SELECT * FROM a WHERE cut IS NULL OR event_id > cut)
SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) FILTER (event_type = 'purchase') AS amount,
  min(ts) AS inserted_ts, max(ts) AS modified_ts FROM l GROUP BY 1
""")
def _(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "user_id", "event_id", "ts", kind.alias("last_type"), F.when(kind == "purchase", F.col("value")).alias("amount"), (kind == "error").alias("gone")
    )
    table = tables.DocumentTable(fresh_path(t.spark, "documents"), "user_id", "event_id", "ts", "gone", "update")
    for i, batch in enumerate(in_thirds(rows, "ts")):
        table.apply(batch, i)
    return table.read(t.spark)


@plan("key_value_projection", "SNK-4 RTE-6", """
WITH l AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o, max(o_orderdate) AS d FROM orders GROUP BY 1)
SELECT 'order:' || o_custkey AS key, o AS o_orderkey,
  CASE p WHEN '3-MEDIUM' THEN d + INTERVAL 1 DAY WHEN '5-LOW' THEN d + INTERVAL 1 HOUR END AS expires_at FROM l
WHERE p NOT IN ('3-MEDIUM', '5-LOW') OR CASE p WHEN '3-MEDIUM' THEN d + INTERVAL 1 DAY ELSE d + INTERVAL 1 HOUR END > TIMESTAMP '2001-01-01'
""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", order_tier().alias("tier"))
    entries = tables.to_key_value(rows, "o_custkey", "order:", "o_orderdate", tier_value("tier", "ttl_s"), ["o_orderdate", "o_orderkey"])
    live = tables.live_entries(entries, instant(datetime(2001, 1, 1)))
    return live.select("key", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "expires_at")


@plan("append_lakehouse", "SNK-5 PII-3", "SELECT event_id, user_id, ts, value FROM events")
def _(t):
    root = fresh_path(t.spark, "lake")
    rows = event_stream(t).select("event_id", "user_id", "ts", "value")
    drained(sinks.append_lakehouse(rows, f"{root}/out", f"{root}/checkpoint", flush=None))
    return t.spark.read.parquet(f"{root}/out")


@plan("append_schematized", "SNK-6", """
SELECT event_id, event_type, value, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN props END AS props FROM events
""")
def _(t):
    table = tables.SchematizedTable(fresh_path(t.spark, "schematized"), "event_type", "event_id")
    first = t.events.filter("ts < TIMESTAMP '2024-01-20 00:00:00'").select("event_id", "event_type", "value")
    second = t.events.filter("ts >= TIMESTAMP '2024-01-10 00:00:00'").select("event_id", "event_type", "value", "props")
    table.apply(first, 0)
    table.apply(second, 1)
    table.apply(second, 1)
    return table.read(t.spark).select("event_id", "event_type", "value", "props")


@plan("materialized_topic", "SNK-7", """
SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1
""")
def _(t):
    root = fresh_path(t.spark, "materialized")
    drained(sinks.materialize_topic(event_stream(t), "bank.events.v1", root, f"{root}/checkpoint", "ts", None))
    table = t.spark.read.parquet(f"{root}/bank_events_v1")
    return table.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@plan("publish_audit", "SNK-8", """
SELECT event_id, target, CASE target WHEN 'siem' THEN 'stream:audit' ELSE 'audit.log' END AS source,
  CASE target WHEN 'siem' THEN 'audit:json' ELSE 'log' END AS sourcetype FROM events, (VALUES ('siem'), ('logs')) c(target)
""")
def _(t):
    root = fresh_path(t.spark, "audit-out")
    targets = {"siem": {"source": "stream:audit", "sourcetype": "audit:json"}, "logs": {"source": "audit.log", "sourcetype": "log"}}
    drained(sinks.publish_audit(event_stream(t).select("event_id"), targets, f"{root}/out", f"{root}/checkpoint"))
    return tables.read_batches(t.spark, f"{root}/out").select("event_id", "target", "source", "sourcetype")


@plan("sink_dead_letters", "SNK-9 DLQ-1", f"""
SELECT id, CASE WHEN NOT ok THEN 'lakehouse.dlq.events' END AS dlq_topic
FROM (SELECT *, coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' END, false) AS ok FROM {_PAYLOADS})
""")
def _(t):
    root = fresh_path(t.spark, "dead-letters")
    write = sinks.with_dead_letters(PAYLOAD, "value", f"{root}/good", f"{root}/dead", "lakehouse", "events")
    write(payloads(t), 0)
    good = tables.read_batches(t.spark, f"{root}/good").select("id")
    dead = tables.read_batches(t.spark, f"{root}/dead").select("id", "dlq_topic")
    return good.unionByName(dead, allowMissingColumns=True)


@plan("mirrored_stream", "SNK-10", """
SELECT event_id, 'east.' || event_type AS topic FROM events WHERE event_type <> 'error'
""")
def _(t):
    root = fresh_path(t.spark, "mirror")
    name = F.when(F.col("event_type") == "error", "__error").otherwise(F.col("event_type"))
    rows = event_stream(t).select("event_id", name.alias("topic"))
    drained(sinks.mirror_stream(rows, "east", f"{root}/out", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/out")


@plan("write_many", "SNK-11 RTE-2", """
SELECT event_id, 'high' AS route FROM events WHERE value > 40 UNION ALL SELECT event_id, 'flagged' FROM events WHERE event_type = 'purchase' AND value > 80
""")
def _(t):
    root = fresh_path(t.spark, "routes")
    routes = {"high": F.col("value") > 40, "flagged": (F.col("event_type") == "purchase") & (F.col("value") > 80)}
    drained(sinks.write_many(event_stream(t), routes, f"{root}/out", f"{root}/checkpoint"))
    return tables.read_batches(t.spark, f"{root}/out").select("event_id", "route")

from pyspark.sql import functions as F

from tidemark.operators.reconcile import offset_lag, reconcile
from tidemark.plans.registry import plan

_RECONCILE = """
SELECT key, count(*) FILTER (side = 'a') AS rows_a, count(*) FILTER (side = 'b') AS rows_b,
  CASE WHEN count(*) FILTER (side = 'b') = 0 THEN 'missing' WHEN count(*) FILTER (side = 'a') = 0 THEN 'extra'
    WHEN list_sort(list(v) FILTER (side = 'a')) = list_sort(list(v) FILTER (side = 'b')) THEN 'same' ELSE 'changed' END AS state
FROM every GROUP BY 1
"""


@plan("reconcile_roundtrip", "REC-1", f"""
WITH every AS (SELECT 'a' AS side, l_orderkey AS key, l_partkey || '|' || l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity < 25
  UNION ALL SELECT 'b', l_orderkey, l_partkey || '|' || CASE WHEN l_returnflag = 'N' AND l_quantity > 49 THEN 0.0::DOUBLE ELSE l_quantity END FROM lineitem WHERE l_returnflag <> 'A' OR l_quantity < 45)
{_RECONCILE}
""")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_partkey", "l_quantity", "l_returnflag")
    sent = rows.filter("l_returnflag <> 'R' OR l_quantity < 25").drop("l_returnflag")
    altered = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 49), 0.0).otherwise(F.col("l_quantity"))
    got = rows.filter("l_returnflag <> 'A' OR l_quantity < 45").withColumn("l_quantity", altered).drop("l_returnflag")
    return reconcile(sent, got, "key")


@plan("reconcile_dual_write", "REC-2", f"""
WITH every AS (SELECT 'a' AS side, event_id AS key, event_type || '|' || user_id AS v FROM events WHERE value > 5
  UNION ALL SELECT 'b', event_id, CASE WHEN value > 200 THEN 'other' ELSE event_type END || '|' || user_id FROM events WHERE value < 220)
{_RECONCILE}
""")
def _(t):
    v1 = t.events.filter("value > 5").select(F.col("event_id").alias("key"), "event_type", "user_id", "props")
    v2 = t.events.filter("value < 220").select(
        F.col("event_id").alias("key"), F.when(F.col("value") > 200, "other").otherwise(F.col("event_type")).alias("event_type"), "user_id")
    return reconcile(v1, v2, "key")


@plan("offset_lag", "REC-3", """
WITH e AS (SELECT o_custkey AS topic, o_orderpriority AS partition, max(o_orderkey) AS end_offset FROM orders GROUP BY ALL),
c AS (SELECT o_custkey AS topic, o_orderpriority AS partition, 'group-' || o_orderstatus AS "group", max(o_orderkey) AS committed FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)
SELECT topic, partition, "group", end_offset, committed, greatest(end_offset - coalesce(committed, 0), 0) AS lag,
  greatest(end_offset - coalesce(committed, 0), 0) = 0 AS drained FROM e LEFT JOIN c USING (topic, partition)
""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("topic"), F.col("o_orderpriority").alias("partition"), "o_orderkey", "o_orderstatus")
    ends = o.groupBy("topic", "partition").agg(F.max("o_orderkey").alias("end_offset"))
    commits = o.filter("o_orderstatus <> 'O'").select(
        "topic", "partition", F.concat(F.lit("group-"), "o_orderstatus").alias("group"), F.col("o_orderkey").alias("committed"))
    return offset_lag(ends, commits)

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import changes as C
from tidemark.operators.retention import apply_cleanup, apply_retention
from tidemark.plans.join_plans import _TIER, order_tier
from tidemark.plans.registry import plan


@plan("compact_latest", "CDC-1 CDC-7", """
SELECT * FROM (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
  FROM orders GROUP BY 1) WHERE o_orderstatus <> 'F'
""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return C.compact(rows, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").drop("o_orderdate")


@plan("dedupe_versions", "CDC-2", "SELECT DISTINCT event_id, ts, value FROM events")
def _(t):
    once = t.events.select("event_id", "ts", "value")
    return C.dedupe_versions(once.unionByName(once.filter("value > 10")), "event_id", "ts")


@plan("resolved_gate", "CDC-3", """
SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup' AND ts <= (SELECT max(ts) FROM events WHERE event_type = 'signup')
""")
def _(t):
    rows = t.events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    marks = t.events.filter("event_type = 'signup'").select(F.col("ts").alias("resolved"))
    return C.release_resolved(rows, marks, "ts")


@plan("resolved_gate_slowest", "CDC-3", """
SELECT event_id, ts FROM events WHERE event_type <> 'signup'
  AND ts <= (SELECT min(m) FROM (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'signup' GROUP BY 1))
""")
def _(t):
    rows = t.events.filter("event_type <> 'signup'").select("event_id", "ts")
    marks = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("resolved"))
    return C.release_resolved(rows, marks, "ts", stream="user_id")


@plan("change_diff", "CDC-4", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'insert' WHEN o_orderstatus = 'F' THEN 'delete'
    WHEN o_totalprice > 200000 OR o_orderpriority <> '5-LOW' THEN 'update' ELSE 'none' END AS change,
  CASE WHEN o_orderstatus = 'O' THEN concat_ws(',', 'price', 'priority') WHEN o_orderstatus = 'F' THEN 'price,priority'
    ELSE concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN o_orderpriority <> '5-LOW' THEN 'priority' END) END AS fields
FROM orders
""")
def _(t):
    o, status = t.orders, F.col("o_orderstatus")
    before = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    after = F.struct(
        F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"),
        F.lit("5-LOW").alias("priority"),
    )
    rows = o.select("o_orderkey", F.when(status != "O", before).alias("before"), F.when(status != "F", after).alias("after"))
    diff = C.diff_change(rows, ["price", "priority"])
    return diff.select("o_orderkey", "change", F.array_join("changed_fields", ",").alias("fields"))


@plan("apply_changes", "CDC-5 CDC-7", """
WITH every AS (
  SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS version, c_acctbal AS balance, false AS gone FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'F' FROM orders)
SELECT id, version, balance FROM (SELECT id, max(version) AS version, arg_max(balance, version) AS balance, arg_max(gone, version) AS gone FROM every GROUP BY 1)
WHERE NOT gone
""")
def _(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("version"), F.col("c_acctbal").alias("balance"))
    changes = t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("balance"),
        (F.col("o_orderstatus") == "F").alias("deleted"),
    )
    return C.apply_changes(target, changes, "id", "version")


@plan("version_history", "CDC-6", """
SELECT event_id, user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events
""")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return C.version_history(rows, "user_id", "ts", "event_id").select("event_id", "user_id", "valid_from", "valid_to")


@plan("retention_by_tier", "RET-1", f"""
WITH t AS (SELECT o_orderkey, o_orderdate, {_TIER} AS tier FROM orders)
SELECT o_orderkey, tier FROM t WHERE epoch_ms(TIMESTAMP '2001-07-31 00:00:00') - epoch_ms(o_orderdate) <=
  CASE tier WHEN 'critical' THEN 604800000 WHEN 'best-effort' THEN 86400000 WHEN 'compliance' THEN 7 * 31557600000 ELSE 259200000 END
""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", order_tier().alias("tier"))
    return apply_retention(rows, "o_orderdate", "tier", datetime(2001, 7, 31), 7).select("o_orderkey", "tier")


@plan("cleanup_policy", "RET-2 RET-1 CDC-1", f"""
WITH t AS (SELECT *, {_TIER} AS tier FROM orders),
kept AS (SELECT * FROM t WHERE tier = 'compliance' OR epoch_ms(TIMESTAMP '2001-07-31 00:00:00') - epoch_ms(o_orderdate) <=
  CASE tier WHEN 'critical' THEN 604800000 WHEN 'best-effort' THEN 86400000 ELSE 259200000 END)
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max_null(tier, (o_orderdate, o_orderkey)) AS tier FROM kept GROUP BY 1
""")
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", order_tier().alias("tier"))
    kept = apply_cleanup(
        rows, "compact,delete", "o_custkey", ["o_orderdate", "o_orderkey"], time="o_orderdate", tier="tier",
        now=datetime(2001, 7, 31), compliance_years=-1,
    )
    return kept.drop("o_orderdate")


@plan("id_difference", "SET-1 GOV-12", """
SELECT o_custkey AS id, 'removed' AS change, false AS allowed FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'
  EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL
SELECT o_custkey, 'added', true FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'
  EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
""")
def _(t):
    from tidemark.operators.governance import check_id_stability

    ids = t.orders.withColumnRenamed("o_custkey", "id")
    return check_id_stability(ids.filter("o_orderstatus = 'O'"), ids.filter("o_orderpriority = '5-LOW'"), "1.4.0", "1.5.0")

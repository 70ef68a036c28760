from pyspark.sql import functions as F

from tidemark.functions import with_thresholds, with_tier
from tidemark.operators.governance import desired_bindings
from tidemark.operators.joins import aligned_diff, asof_join, match_on, missing_elements, stale
from tidemark.plans.registry import plan


@plan("asof_last_view", "JOIN-1", """
SELECT p.event_id AS transaction_id, p.user_id AS account, p.value AS amount, p.ts, v.event_id AS profile_id, v.value AS rating
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def _(t):
    e = t.events
    left = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account"), F.col("value").alias("amount"), "ts"
    )
    right = e.filter("event_type = 'view'").select(
        F.col("user_id").alias("account"), F.col("ts").alias("valid_from"), F.col("event_id").alias("profile_id"),
        F.col("value").alias("rating"),
    )
    return asof_join(left, right, "account", "ts", "valid_from", order="profile_id")


@plan("asof_account_master", "JOIN-2", """
SELECT e.event_id AS transaction_id, e.user_id AS account, e.event_type AS kind, s.event_id AS signup_id, s.props AS holder
FROM (SELECT * FROM events WHERE event_type <> 'signup') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def _(t):
    e = t.events
    left = e.filter("event_type <> 'signup'").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account"), F.col("event_type").alias("kind"), "ts"
    )
    right = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("account"), F.col("ts").alias("since"), F.col("event_id").alias("signup_id"),
        F.col("props").alias("holder"),
    )
    return asof_join(left, right, "account", "ts", "since", how="left", order="signup_id").drop("ts")


_TIER = """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'compliance' WHEN '3-MEDIUM' THEN 'standard'
  WHEN '5-LOW' THEN 'best-effort' END"""


@plan("tier_lookup", "JOIN-3", """
WITH topics AS (SELECT c_custkey AS topic, CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY' THEN 'compliance'
  WHEN 'HOUSEHOLD' THEN 'best-effort' END AS tier FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, o_custkey AS topic, coalesce(tier, 'standard') AS tier FROM orders LEFT JOIN topics ON o_custkey = topic
""")
def _(t):
    seg = F.col("c_mktsegment")
    topics = t.customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("topic"),
        F.when(seg == "BUILDING", "critical").when(seg == "MACHINERY", "compliance").when(seg == "HOUSEHOLD", "best-effort")
        .alias("tier"),
    )
    return with_tier(t.orders.select("o_orderkey", F.col("o_custkey").alias("topic")), topics).select("o_orderkey", "topic", "tier")


@plan("vector_match", "JOIN-4", """
WITH a AS (SELECT user_id, count(*) AS lag FROM events WHERE event_type = 'error' GROUP BY 1),
     b AS (SELECT user_id, count(*) AS received FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, lag, received FROM a JOIN b USING (user_id)
""")
def _(t):
    a = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("lag"))
    b = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("received"))
    return match_on(a, b, "user_id")


@plan("tier_thresholds", "JOIN-5", f"""
SELECT o_orderkey, tier,
  CASE tier WHEN 'critical' THEN 30 WHEN 'best-effort' THEN 3600 WHEN 'compliance' THEN 10 ELSE 300 END::BIGINT AS warn,
  CASE tier WHEN 'critical' THEN 60 WHEN 'best-effort' THEN 14400 WHEN 'compliance' THEN 30 ELSE 900 END::BIGINT AS alert
FROM (SELECT o_orderkey, {_TIER} AS tier FROM orders)
""")
def _(t):
    return with_thresholds(t.orders.select("o_orderkey", order_tier().alias("tier")))


def order_tier():
    p = F.col("o_orderpriority")
    return (F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "compliance").when(p == "3-MEDIUM", "standard")
            .when(p == "5-LOW", "best-effort"))


@plan("stale_bindings", "JOIN-6", """
SELECT DISTINCT 'User:' || l_suppkey AS principal, 'topic-' || l_partkey AS name FROM lineitem WHERE l_returnflag = 'R'
EXCEPT SELECT DISTINCT 'User:' || l_suppkey, 'topic-' || l_partkey FROM lineitem WHERE l_returnflag <> 'R'
""")
def _(t):
    rows = t.lineitem.select(
        F.concat(F.lit("User:"), "l_suppkey").alias("principal"), F.concat(F.lit("topic-"), "l_partkey").alias("name"), "l_returnflag"
    )
    current = rows.filter("l_returnflag = 'R'").select("principal", "name").distinct()
    return stale(current, rows.filter("l_returnflag <> 'R'"), ["principal", "name"])


@plan("missing_fields", "JOIN-7", """
WITH d AS (SELECT o_custkey AS topic, unnest([o_orderpriority, 'f-' || o_orderstatus]) AS field FROM orders),
     f AS (SELECT o_custkey AS topic, o_orderpriority AS field FROM orders WHERE o_orderstatus = 'O')
SELECT DISTINCT topic, field FROM d EXCEPT SELECT topic, field FROM f
""")
def _(t):
    declared = t.orders.select(
        F.col("o_custkey").alias("topic"), F.array("o_orderpriority", F.concat(F.lit("f-"), "o_orderstatus")).alias("declared")
    )
    fields = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("topic"), F.col("o_orderpriority").alias("field"))
    return missing_elements(declared, "declared", fields, "topic", "field")


@plan("aligned_drift", "JOIN-8", """
WITH a AS (SELECT o_custkey AS topic, o_orderpriority AS name, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL),
     d AS (SELECT o_custkey AS topic, o_orderpriority AS name, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT coalesce(a.topic, d.topic) AS topic, coalesce(a.name, d.name) AS name,
  CASE WHEN a.topic IS NULL THEN 'missing' WHEN d.topic IS NULL THEN 'extra' WHEN a.n = d.n AND a.top = d.top THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN d ON a.topic = d.topic AND a.name = d.name
""")
def _(t):
    def settings(where):
        return t.orders.filter(where).groupBy(F.col("o_custkey").alias("topic"), F.col("o_orderpriority").alias("name")).agg(
            F.count("*").alias("n"), F.max("o_totalprice").alias("top"))

    out = aligned_diff(settings("o_orderstatus <> 'O'"), settings("o_orderstatus <> 'F'"), ["topic", "name"], ["n", "top"])
    return out.select("topic", "name", "state")


def binding_topics(t):
    """One row per customer: suppliers of its nation's letter as producers and consumers."""
    return t.customer.select(
        F.concat(F.lit("topic-"), "c_custkey").alias("topic"),
        F.array(F.concat(F.lit("User:p"), "c_nationkey")).alias("producers"),
        F.when(F.col("c_acctbal") > 0, F.array(F.concat(F.lit("User:c"), "c_nationkey"), F.lit("svc"))).alias("consumers"),
    )


@plan("desired_bindings", "GOV-9", """
WITH b AS (SELECT 'topic-' || c_custkey AS topic, 'User:p' || c_nationkey AS p, CASE WHEN c_acctbal > 0 THEN 'User:c' || c_nationkey END AS c,
  CASE WHEN c_acctbal > 0 THEN 'svc' END AS s, c_nationkey AS n FROM customer),
w AS (SELECT p AS principal, 'DeveloperWrite' AS role, topic FROM b),
r AS (SELECT c AS principal, 'DeveloperRead' AS role, topic FROM b WHERE c IS NOT NULL UNION ALL SELECT s, 'DeveloperRead', topic FROM b WHERE s IS NOT NULL),
a AS (SELECT * FROM w UNION ALL SELECT * FROM r)
SELECT DISTINCT principal, role, 'Topic' AS resource_type, topic AS name, 'LITERAL' AS pattern_type FROM a
UNION SELECT principal, role, 'Subject', topic || '-value', 'LITERAL' FROM a
UNION SELECT principal, role, 'Subject', topic || '-key', 'LITERAL' FROM a
UNION SELECT c, 'DeveloperRead', 'Group', 'c' || n || '-', 'PREFIXED' FROM b WHERE c IS NOT NULL
""")
def _(t):
    return desired_bindings(binding_topics(t))

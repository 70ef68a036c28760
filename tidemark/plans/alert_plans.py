from pyspark.sql import functions as F

from tidemark.operators import alerts as A
from tidemark.operators import recovery as R
from tidemark.operators.series import count_series, increase, latest
from tidemark.plans.join_plans import _TIER, order_tier
from tidemark.plans.registry import plan
from tidemark.plans.series_plans import _SAMPLES, _pairs, counters

_WARN = "CASE tier WHEN 'critical' THEN 30 WHEN 'best-effort' THEN 3600 WHEN 'compliance' THEN 10 ELSE 300 END::BIGINT"
_ALERT = "CASE tier WHEN 'critical' THEN 60 WHEN 'best-effort' THEN 14400 WHEN 'compliance' THEN 30 ELSE 900 END::BIGINT"
_EVENT_TIER = """CASE event_type WHEN 'click' THEN 'critical' WHEN 'view' THEN 'standard' WHEN 'purchase' THEN 'best-effort'
  WHEN 'signup' THEN 'compliance' END"""


def event_tier():
    kind = F.col("event_type")
    return (F.when(kind == "click", "critical").when(kind == "view", "standard").when(kind == "purchase", "best-effort")
            .when(kind == "signup", "compliance"))


@plan("assess_lag", "ALR-1", f"""
SELECT o_orderkey, tier, lag_s, CASE WHEN lag_s >= {_ALERT} THEN 'ALERT' WHEN lag_s >= {_WARN} THEN 'WARN' ELSE 'OK' END AS status
FROM (SELECT o_orderkey, {_TIER} AS tier, CAST(floor(o_totalprice / 100) AS BIGINT) AS lag_s FROM orders)
""")
def _(t):
    rows = t.orders.select("o_orderkey", order_tier().alias("tier"), F.floor(F.col("o_totalprice") / 100).alias("lag_s"))
    return A.assess_lag(rows).select("o_orderkey", "tier", "lag_s", "status")


def _islands(samples: str, rules: str, gap_s: int, by: str) -> str:
    """SQL of sustained alerts: number the runs of breaching samples, then keep those held long enough."""
    cols = by.replace(" ", "")
    return f"""
WITH samples AS ({samples}), rules(rule, metric, op, lim, hold_s, severity, tier) AS (VALUES {rules}),
r AS (SELECT s.*, rules.rule, rules.hold_s, rules.severity,
        CASE op WHEN 'gt' THEN value > lim ELSE value < lim END AS breached
      FROM samples s JOIN rules ON s.metric = rules.metric AND (rules.tier IS NULL OR rules.tier = coalesce(s.tier, 'standard'))),
m AS (SELECT *, lag(breached) OVER w AS was, lag(ts) OVER w AS prev_ts FROM r WINDOW w AS (PARTITION BY rule, {cols} ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN prev_ts IS NULL OR NOT was OR epoch_us(ts) - epoch_us(prev_ts) > {gap_s}::BIGINT * 1000000 THEN 1 ELSE 0 END AS starts FROM m WHERE breached),
i AS (SELECT *, sum(starts) OVER (PARTITION BY rule, {cols} ORDER BY ts, event_id) AS island FROM f)
SELECT rule, {cols}, min(ts) AS started, max(ts) AS last_seen, count(*) AS samples, max(value) AS peak,
  min(ts) + to_seconds(any_value(hold_s)) AS fired_at, any_value(severity) AS severity
FROM i GROUP BY rule, {cols}, island HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= any_value(hold_s)::BIGINT * 1000000
"""


_SUSTAINED = "'value-warn', 'value', 'gt', 40.0, 3600, 'warn', NULL), ('value-alert', 'value', 'gt', 80.0, 3600, 'alert', NULL), ('value-low', 'value', 'lt', 25.0, 7200, 'warn', NULL"


@plan("alerts_sustained", "ALR-2 ALR-9", _islands(
    "SELECT event_id, user_id, ts, value, 'value' AS metric, CAST(NULL AS VARCHAR) AS tier FROM events", f"({_SUSTAINED})", 43200, "user_id"
))
def _(t):
    rules = [
        A.Rule("value-warn", "value", "gt", 40.0, 3600, "warn"),
        A.Rule("value-alert", "value", "gt", 80.0, 3600, "alert"),
        A.Rule("value-low", "value", "lt", 25.0, 7200, "warn"),
    ]
    samples = t.events.select("event_id", "user_id", "ts", "value", F.lit("value").alias("metric"))
    return A.alert_sustained(samples, rules, "user_id", max_gap="12 hours", order="event_id").drop("hold_s")


_MIRROR = """('mirror-lag-critical-warn','m','gt',30,60,'warn','critical'),('mirror-lag-critical-alert','m','gt',60,60,'alert','critical'),
('mirror-lag-standard-warn','m','gt',300,300,'warn','standard'),('mirror-lag-standard-alert','m','gt',900,300,'alert','standard'),
('mirror-lag-best-effort-warn','m','gt',3600,900,'warn','best-effort'),('mirror-lag-best-effort-alert','m','gt',14400,900,'alert','best-effort'),
('mirror-lag-compliance-warn','m','gt',10,60,'warn','compliance'),('mirror-lag-compliance-alert','m','gt',30,60,'alert','compliance')"""


@plan("mirror_lag_alerts", "ALR-3", _islands(
    f"SELECT event_id, user_id, event_type, ts, value * 100 AS value, 'm' AS metric, {_EVENT_TIER} AS tier FROM events", _MIRROR, 345600,
    "user_id, event_type",
))
def _(t):
    samples = t.events.select(
        "event_id", "user_id", "event_type", "ts", (F.col("value") * 100).alias("value"), F.lit("m").alias("metric"), event_tier().alias("tier")
    )
    rules = A.mirror_lag_rules("m")
    return A.alert_sustained(samples, rules, ["user_id", "event_type"], max_gap="4 days", order="event_id").drop("hold_s")


_CONSUMER = """('consumer-lag-critical-warn','m','gt',1000,300,'warn','critical'),('consumer-lag-critical-alert','m','gt',5000,300,'alert','critical'),
('consumer-lag-standard-warn','m','gt',10000,300,'warn','standard'),('consumer-lag-standard-alert','m','gt',50000,300,'alert','standard'),
('consumer-lag-best-effort-warn','m','gt',100000,600,'warn','best-effort'),('consumer-lag-best-effort-alert','m','gt',500000,600,'alert','best-effort'),
('consumer-lag-compliance-warn','m','gt',500,300,'warn','compliance'),('consumer-lag-compliance-alert','m','gt',2000,300,'alert','compliance')"""


@plan("consumer_lag_alerts", "ALR-4", _islands(
    f"SELECT event_id, user_id, event_type, ts, value * 1000 AS value, 'm' AS metric, {_EVENT_TIER} AS tier FROM events", _CONSUMER, 345600,
    "user_id, event_type",
))
def _(t):
    samples = t.events.select(
        "event_id", "user_id", "event_type", "ts", (F.col("value") * 1000).alias("value"), F.lit("m").alias("metric"), event_tier().alias("tier")
    )
    rules = A.consumer_lag_rules("m")
    return A.alert_sustained(samples, rules, ["user_id", "event_type"], max_gap="4 days", order="event_id").drop("hold_s")


_PLATFORM_METRIC = """CASE event_type WHEN 'error' THEN 'under_replicated_partitions' WHEN 'click' THEN 'active_controllers'
  WHEN 'view' THEN 'pending_records' WHEN 'purchase' THEN 'slot_retained_bytes' ELSE 'records_out_rate_10m' END"""
_PLATFORM_VALUE = "CASE event_type WHEN 'error' THEN value - 10 WHEN 'click' THEN value / 20 WHEN 'view' THEN value * 200 WHEN 'purchase' THEN value * 40000000 ELSE value / 20 END"
_PLATFORM = """('under-replicated','under_replicated_partitions','gt',0,300,'alert',NULL),('no-controller','active_controllers','lt',1,60,'alert',NULL),
('pending-warn','pending_records','gt',1000,300,'warn',NULL),('pending-alert','pending_records','gt',10000,300,'alert',NULL),
('throughput-drop','records_out_rate_10m','lt',1,600,'warn',NULL),('slot-retention','slot_retained_bytes','gt',1073741824,0,'alert',NULL),
('connector-failed','failed_connectors','gt',0,60,'alert',NULL),('restart-loop','task_restarts_15m','gt',3,60,'alert',NULL)"""


@plan("platform_alerts", "ALR-7 ALR-9 ALR-10 ALR-11", _islands(
    f"SELECT event_id, user_id, ts, {_PLATFORM_VALUE} AS value, {_PLATFORM_METRIC} AS metric, CAST(NULL AS VARCHAR) AS tier FROM events",
    _PLATFORM, 864000, "user_id",
))
def _(t):
    kind, v = F.col("event_type"), F.col("value")
    metric = (F.when(kind == "error", "under_replicated_partitions").when(kind == "click", "active_controllers")
              .when(kind == "view", "pending_records").when(kind == "purchase", "slot_retained_bytes").otherwise("records_out_rate_10m"))
    value = (F.when(kind == "error", v - 10).when(kind == "click", v / 20).when(kind == "view", v * 200)
             .when(kind == "purchase", v * 40000000).otherwise(v / 20))
    samples = t.events.select("event_id", "user_id", "ts", value.alias("value"), metric.alias("metric"))
    rules = A.PLATFORM_RULES
    return A.alert_sustained(samples, rules, "user_id", max_gap="10 days", order="event_id").drop("hold_s")


@plan("warn_band", "ALR-5", f"""
WITH l AS (SELECT user_id, event_type, {_EVENT_TIER} AS tier, arg_max(value * 100, (ts, event_id)) AS lag_s FROM events GROUP BY ALL)
SELECT user_id, event_type, lag_s FROM l WHERE lag_s > {_WARN} AND lag_s <= {_ALERT}
""")
def _(t):
    newest = latest(t.events.withColumn("lag_s", F.col("value") * 100), ["user_id", "event_type"], "ts", ["lag_s"], "event_id")
    return A.warn_band(newest.withColumn("tier", event_tier()), "lag_s").select("user_id", "event_type", "lag_s")


@plan("average_over_limit", "ALR-6", f"""
WITH s AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS value FROM events),
a AS (SELECT event_id, CAST(sum(value) OVER w AS DOUBLE) / count(*) OVER w AS window_avg FROM s
      WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW))
SELECT event_id, window_avg FROM a WHERE window_avg > 6000
""")
def _(t):
    return A.alert_avg(counters(t), "user_id", "ts", "value", "6 hours", 6000.0).select("event_id", "window_avg")


@plan("restart_loops", "ALR-8 TS-2", f"""
WITH {_pairs(_SAMPLES, 'user_id, event_type', 172800)}
SELECT event_id, CAST(inc AS BIGINT) AS increase FROM windows WHERE us > 0 AND inc > 3
""")
def _(t):
    return increase(counters(t), ["user_id", "event_type"], "2 days").filter("increase > 3").select("event_id", "increase")


def _burst_sql(where: str, seconds: int, at_least: int, by: str = "user_id") -> str:
    return f"""
SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY {by} ORDER BY ts
  RANGE BETWEEN INTERVAL '{seconds - 1}.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM events WHERE {where}) WHERE in_window >= {at_least}
"""


@plan("auth_bursts", "ALR-12", _burst_sql("event_type IN ('error', 'click')", 259200, 6))
def _(t):
    failed = F.col("event_type").isin("error", "click")
    return A.auth_bursts(t.events, 5, "3 days", "user_id", failed=failed).select("event_id", "in_window")


@plan("denied_on_topic", "ALR-13", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND props = '{\"k\": 9}'")
def _(t):
    audit = t.events.withColumns({
        "result": F.when(F.col("event_type") == "error", "DENIED").otherwise("ALLOWED"), "resource": F.col("props"),
    })
    return A.denied_on(audit, '{"k": 9}').select("event_id", "ts")


@plan("unauthorised_deletes", "ALR-14", """
SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE value > 300)
""")
def _(t):
    admins = t.events.filter("value > 300").select("user_id")
    out = A.unauthorised_deletes(t.events, admins, "user_id", F.col("event_type") == "error")
    return out.select("event_id", "user_id")


@plan("outside_windows", "ALR-15", """
WITH w AS (SELECT ts AS f, ts + INTERVAL 30 MINUTE AS u FROM events WHERE event_type = 'signup' AND value > 50)
SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM w WHERE e.ts >= w.f AND e.ts < w.u)
""")
def _(t):
    windows = t.events.filter("event_type = 'signup' AND value > 50").select(
        F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end")
    )
    return A.outside_windows(t.events.filter("event_type = 'error'"), windows).select("event_id")


@plan("confidential_reads", "ALR-16", """
SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL '172799.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM events
  WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE in_window >= 2
""")
def _(t):
    topics = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "confidential").otherwise("internal").alias("classification"),
    )
    out = A.confidential_access(t.events, topics, "2 days", 2, "user_id", denied=F.col("event_type") == "error")
    return out.select("event_id", "in_window")


@plan("decryption_failures", "ALR-17", _burst_sql("event_type = 'error'", 432000, 6))
def _(t):
    return A.decryption_failures(t.events.filter("event_type = 'error'"), "user_id", 5, "5 days").select("event_id", "in_window")


_STATUS = f"""
l AS (SELECT o_custkey AS topic, max(CAST(floor(o_totalprice * 10) AS BIGINT)) // 1000 AS lag_s FROM orders GROUP BY 1),
t AS (SELECT c_custkey AS topic, CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY' THEN 'best-effort' WHEN 'HOUSEHOLD' THEN 'compliance' END AS tier FROM customer),
j AS (SELECT topic, coalesce(tier, 'standard') AS tier, lag_s FROM l LEFT JOIN t USING (topic)),
s AS (SELECT topic, tier, lag_s, {_WARN} AS warn_s, {_ALERT} AS threshold_s,
  CASE WHEN lag_s >= {_ALERT} THEN 'ALERT' WHEN lag_s >= {_WARN} THEN 'WARN' ELSE 'OK' END AS status FROM j)
"""


def replication(t):
    lags = t.orders.select(F.col("o_custkey").alias("topic"), F.floor(F.col("o_totalprice") * 10).alias("lag_ms"))
    seg = F.col("c_mktsegment")
    tier = F.when(seg == "BUILDING", "critical").when(seg == "MACHINERY", "best-effort").when(seg == "HOUSEHOLD", "compliance")
    return R.dr_status(lags, t.customer.select(F.col("c_custkey").alias("topic"), tier.alias("tier")))


@plan("dr_status", "DR-1 JOIN-3", f"WITH {_STATUS} SELECT topic, tier, lag_s, warn_s, threshold_s, status FROM s")
def _(t):
    return replication(t)


@plan("lag_summary", "AGG-13 DR-1", f"""
WITH {_STATUS}, c AS (SELECT count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'ALERT') AS alert FROM s)
SELECT *, ok || ' topics OK, ' || warn || ' WARN, ' || alert || ' ALERT' AS summary FROM c
""")
def _(t):
    return R.lag_summary(replication(t))


@plan("failover_risk", "DR-2", f"WITH {_STATUS} SELECT topic, tier, lag_s, threshold_s FROM s WHERE status = 'ALERT'")
def _(t):
    return R.failover_risk(replication(t)).select("topic", "tier", "lag_s", "threshold_s")


@plan("all_synced", "DR-3", f"WITH {_STATUS} SELECT coalesce(bool_and(lag_s < warn_s), true) AS all_synced FROM s")
def _(t):
    return R.all_synced(replication(t))


def steps(t):
    """Each order as one step of its customer's drill."""
    seconds = (F.col("o_orderkey") % 7200).cast("long")
    return t.orders.select(
        F.col("o_custkey").alias("drill"), F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("start"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + seconds * 1000000).alias("end"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("result"),
    )


def _duration(s: str) -> str:
    return f"""CASE WHEN {s} // 3600 > 0 THEN ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm'
  WHEN {s} % 3600 // 60 > 0 THEN ({s} % 3600 // 60) || 'm ' || ({s} % 60) || 's' ELSE ({s} % 60) || 's' END"""


@plan("drill_steps", "DR-4", f"""
SELECT o_custkey AS drill, o_orderkey AS number, o_orderkey % 7200 AS duration_s, {_duration('(o_orderkey % 7200)')} AS duration,
  CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END AS result FROM orders
""")
def _(t):
    return R.drill_report(steps(t)).select("drill", "number", "duration_s", "duration", "result")


@plan("drill_verdicts", "DR-4", f"""
WITH d AS (SELECT o_custkey AS drill, count(*) AS steps, count(*) FILTER (o_orderstatus <> 'F') AS passed,
  CASE WHEN bool_and(o_orderstatus <> 'F') THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CAST(epoch(max(o_orderdate + to_seconds(o_orderkey % 7200))) - epoch(min(o_orderdate)) AS BIGINT) AS total_s FROM orders GROUP BY 1)
SELECT *, {_duration('total_s')} AS total FROM d
""")
def _(t):
    return R.drill_verdict(steps(t), "drill")


@plan("status_labels", "DR-5", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'OTHER' END AS label FROM orders
""")
def _(t):
    label = R.case_map(F.col("o_orderstatus"), {"O": "RUNNING", "F": "FAILED"}, "OTHER")
    return t.orders.select("o_orderkey", label.alias("label"))


@plan("rpo_compliance", "DR-6", f"""
SELECT o_orderkey, tier, CASE WHEN tier = 'compliance' THEN loss_s = 0 ELSE loss_s < CASE tier WHEN 'critical' THEN 300 WHEN 'best-effort' THEN 86400 ELSE 7200 END END AS rpo_met,
  outage_s < CASE tier WHEN 'critical' THEN 900 WHEN 'compliance' THEN 900 WHEN 'best-effort' THEN 14400 ELSE 3600 END AS rto_met
FROM (SELECT o_orderkey, {_TIER} AS tier, CAST(o_orderkey % 90000 AS BIGINT) AS loss_s, CAST(o_custkey % 20000 AS BIGINT) AS outage_s FROM orders)
""")
def _(t):
    rows = t.orders.select(
        "o_orderkey", order_tier().alias("tier"), (F.col("o_orderkey") % 90000).alias("loss_s"), (F.col("o_custkey") % 20000).alias("outage_s")
    )
    return R.rpo_check(rows).select("o_orderkey", "tier", "rpo_met", "rto_met")


@plan("assessment_labels", "DR-5 AGG-8", """
SELECT user_id, arg_max(value, (ts, event_id)) AS lag, CASE WHEN arg_max(value, (ts, event_id)) <= 30 THEN 'OK'
  WHEN arg_max(value, (ts, event_id)) <= 60 THEN 'WARN' ELSE 'ALERT' END AS assessment FROM events GROUP BY 1
""")
def _(t):
    newest = latest(t.events, "user_id", "ts", ["value"], "event_id")
    return newest.select("user_id", F.col("value").alias("lag"), R.assess_upto(F.col("value"), 30, 60).alias("assessment"))


@plan("restart_counts", "ALR-8", """
SELECT user_id, count(*) AS restart_count FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3
""")
def _(t):
    counted = count_series(t.events.filter("event_type = 'error'"), by="user_id", out="restart_count")
    return counted.filter("restart_count >= 3")

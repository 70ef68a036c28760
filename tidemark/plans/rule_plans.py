"""Alerts whose rules are expressions over raw counters and gauges."""

from pyspark.sql import functions as F

from tidemark.operators.rules import GraphRule, Math, Over, Series, Holds, alerts_from_samples, evaluated
from tidemark.plans.registry import plan

# Per connector task: a state gauge (1: failed), restarts, and records read and written.
_METRIC = "CASE event_type WHEN 'error' THEN 'connector_state' WHEN 'click' THEN 'task_restarts' WHEN 'view' THEN 'records_in' WHEN 'purchase' THEN 'records_out' END"
_VALUE = "CASE WHEN event_type = 'error' THEN CASE WHEN value > 60 THEN 1 ELSE 0 END ELSE CAST(round(value * 100) AS BIGINT) END"

_FAILED = Over("sum", Holds(Series("connector_state", "last", "2 days"), "ge", 1.0))
_OUT = Over("sum", Series("records_out", "increase", "1 day"))
_IN = Over("sum", Series("records_in", "increase", "1 day"))
RULES = (
    GraphRule("connector-failed", _FAILED, "gt", 0.0, 43200),
    GraphRule("connectors-failed-share", Math("/", _FAILED, Over("count", Series("connector_state", "last", "2 days"))), "ge", 0.3, 43200, "warn"),
    GraphRule("restart-loop", Series("task_restarts", "increase", "2 days"), "gt", 40000.0, 43200),
    GraphRule("throughput-drop", Math("/", _OUT, _IN), "lt", 0.8, 43200, "warn"),
)


def _samples(t):
    kind = F.col("event_type")
    metric = (F.when(kind == "error", "connector_state").when(kind == "click", "task_restarts")
              .when(kind == "view", "records_in").when(kind == "purchase", "records_out"))
    value = F.when(kind == "error", (F.col("value") > 60).cast("long")).otherwise(F.round(F.col("value") * 100).cast("long"))
    rows = t.events.filter(kind.isin("error", "click", "view", "purchase"))
    return rows.select(metric.alias("metric"), (F.col("user_id") % 10).alias("task"), "ts", value.alias("value"))


_VALUES = f"""
samples AS (SELECT {_METRIC} AS metric, user_id % 10 AS task, ts, {_VALUE} AS value FROM events WHERE event_type <> 'signup'),
grown AS (SELECT *, CASE WHEN value >= lag(value) OVER s THEN value - lag(value) OVER s WHEN lag(value) OVER s IS NOT NULL THEN value ELSE 0 END AS step
          FROM samples WINDOW s AS (PARTITION BY metric, task ORDER BY ts)),
totals AS (SELECT *, sum(step) OVER (PARTITION BY metric, task ORDER BY ts) AS total FROM grown),
points AS (SELECT make_timestamp(k * 21600000000::BIGINT) AS at_ FROM (
  SELECT unnest(range(epoch_us(min(ts)) // 21600000000::BIGINT, (epoch_us(max(ts)) + 172800000000::BIGINT) // 21600000000::BIGINT + 1)) AS k FROM samples)),
stepped AS (SELECT metric, task, back, at_, arg_max(value, ts) AS last, CASE WHEN max(ts) > min(ts) THEN arg_max(total, ts) - arg_min(total, ts) END AS increase
  FROM points, (VALUES (86400), (172800)) AS b(back) JOIN totals ON ts <= at_ AND ts > at_ - to_seconds(back) GROUP BY ALL),
failed AS (SELECT at_, CAST(count(*) FILTER (last >= 1) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS every FROM stepped WHERE metric = 'connector_state' AND back = 172800 GROUP BY 1),
flow AS (SELECT at_, CAST(sum(increase) FILTER (metric = 'records_out') AS DOUBLE) AS o, CAST(sum(increase) FILTER (metric = 'records_in') AS DOUBLE) AS i FROM stepped WHERE back = 86400 GROUP BY 1),
v(rule, task, ts, value) AS (
  SELECT 'connector-failed', NULL::BIGINT, at_, bad FROM failed
  UNION ALL SELECT 'connectors-failed-share', NULL, at_, bad / every FROM failed
  UNION ALL SELECT 'restart-loop', task, at_, CAST(increase AS DOUBLE) FROM stepped WHERE metric = 'task_restarts' AND back = 172800 AND increase IS NOT NULL
  UNION ALL SELECT 'throughput-drop', NULL, at_, o / i FROM flow WHERE o IS NOT NULL AND i <> 0)
"""


@plan("rule_values_at_steps", "ALR-7 ALR-8 ALR-9 AGG-2 AGG-5 AGG-11", f"WITH {_VALUES} SELECT rule, task, ts, value FROM v")
def _(t):
    return evaluated(_samples(t), RULES, "task", "6 hours")


@plan("alerts_from_counters", "ALR-2 ALR-7 ALR-8 ALR-9 TS-2", f"""
WITH {_VALUES},
limits(rule, op, lim, severity) AS (VALUES ('connector-failed', 'gt', 0.0::DOUBLE, 'alert'), ('connectors-failed-share', 'ge', 0.3, 'warn'), ('restart-loop', 'gt', 40000.0, 'alert'), ('throughput-drop', 'lt', 0.8, 'warn')),
r AS (SELECT v.*, severity, CASE op WHEN 'gt' THEN value > lim WHEN 'ge' THEN value >= lim ELSE value < lim END AS breached FROM v JOIN limits USING (rule)),
m AS (SELECT *, lag(breached) OVER w AS was, lag(ts) OVER w AS prev_ts FROM r WINDOW w AS (PARTITION BY rule, task ORDER BY ts)),
f AS (SELECT *, CASE WHEN prev_ts IS NULL OR NOT was OR ts - prev_ts > INTERVAL 9 HOUR THEN 1 ELSE 0 END AS starts FROM m WHERE breached),
i AS (SELECT *, sum(starts) OVER (PARTITION BY rule, task ORDER BY ts) AS island FROM f)
SELECT rule, task, min(ts) AS started, max(ts) AS last_seen, count(*) AS samples, max(value) AS peak, min(ts) + INTERVAL 12 HOUR AS fired_at, any_value(severity) AS severity
FROM i GROUP BY rule, task, island HAVING max(ts) - min(ts) >= INTERVAL 12 HOUR
""")
def _(t):
    return alerts_from_samples(_samples(t), RULES, "task", "6 hours").drop("hold_s")

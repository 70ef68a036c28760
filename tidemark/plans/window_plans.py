from pyspark.sql import functions as F

from tidemark.operators.windows import amount_stats, timechart, tumbling
from tidemark.plans.registry import plan

_STATS = """
  count(*) AS transaction_count,
  CAST(sum(amount) AS DECIMAL(25,2)) AS total_amount,
  CAST(CAST((2 * CAST(sum(amount) * 100 AS BIGINT) + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS avg_amount,
  min(amount) AS min_amount,
  max(amount) AS max_amount
"""
_AMOUNTS = "(SELECT *, CAST(value AS DECIMAL(15,2)) AS amount FROM events)"


@plan("tumbling_1m", "AGG-1 PRJ-1", f"""
SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end, {_STATS}
FROM {_AMOUNTS} GROUP BY ALL
""")
def _(t):
    return tumbling(t.events, "ts", "1 minute", amount_stats("value"))


@plan("tumbling_1h_by_type", "AGG-1", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, {_STATS}
FROM {_AMOUNTS} GROUP BY ALL
""")
def _(t):
    return tumbling(t.events, "ts", "1 hour", amount_stats("value"), "event_type")


@plan("timechart_5m", "TS-4", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS span_start, event_type, max(value) AS max_value FROM events GROUP BY ALL
""")
def _(t):
    return timechart(t.events, "ts", "5 minutes", "event_type", F.max("value").alias("max_value"))


@plan("timechart_pivot", "TS-4", """
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS span_start,
  max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
  max(value) FILTER (event_type = 'purchase') AS purchase
FROM events GROUP BY 1
""")
def _(t):
    return timechart(t.events, "ts", "15 minutes", "event_type", F.max("value"), ["click", "error", "purchase"])

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.steps import at_steps
from tidemark.plans.registry import plan

_C = "CAST(round(value * 100) AS BIGINT)"


def counters(t):
    """Events as counter samples: a smaller value than before is a reset."""
    return t.events.select("event_id", "user_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("value"))


def _pairs(source: str, by: str, seconds: int, extra: str = "") -> str:
    """SQL of the counter increase: steps in the look-back without the step into its first sample."""
    return f"""
samples AS ({source}),
steps AS (SELECT *, CASE WHEN value >= lag(value) OVER s THEN value - lag(value) OVER s
                         WHEN lag(value) OVER s IS NOT NULL THEN value ELSE 0 END AS step
          FROM samples WINDOW s AS (PARTITION BY {by} ORDER BY ts)),
windows AS (SELECT *, sum(step) OVER w - first_value(step) OVER w AS inc, epoch_us(ts) - epoch_us(first_value(ts) OVER w) AS us
            FROM steps WINDOW w AS (PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL '{seconds - 1}.999999 seconds' PRECEDING AND CURRENT ROW))
"""


_SAMPLES = f"SELECT event_id, user_id, event_type, ts, {_C} AS value FROM events"


@plan("increase_lookback", "TS-2", f"""
WITH {_pairs(_SAMPLES, 'user_id', 21600)}
SELECT event_id, CAST(CASE WHEN us > 0 THEN inc END AS BIGINT) AS increase FROM windows
""")
def _(t):
    return S.increase(counters(t), "user_id", "6 hours").select("event_id", "increase")


@plan("rate_lookback", "TS-1 TS-3", f"""
WITH {_pairs(_SAMPLES, 'user_id', 21600)}
SELECT event_id, CASE WHEN us > 0 THEN CAST(inc AS DOUBLE) / (CAST(us AS DOUBLE) / 1e6) END AS rate,
  CASE WHEN us > 0 THEN CAST(inc AS DOUBLE) / (CAST(us AS DOUBLE) / 1e6) * 60.0 END AS per_minute FROM windows
""")
def _(t):
    out = S.rate(counters(t), "user_id", "6 hours")
    return out.select("event_id", "rate", (F.col("rate") * 60.0).alias("per_minute"))


@plan("rate_5m", "TS-1", f"""
WITH {_pairs(_SAMPLES, 'event_type', 300)}
SELECT event_id, CASE WHEN us > 0 THEN CAST(inc AS DOUBLE) / (CAST(us AS DOUBLE) / 1e6) END AS rate FROM windows
""")
def _(t):
    return S.rate(counters(t), "event_type", "5 minutes").select("event_id", "rate")


@plan("increase_15m", "TS-2", f"""
WITH {_pairs(_SAMPLES, 'event_type', 900)}
SELECT event_id, CAST(CASE WHEN us > 0 THEN inc END AS BIGINT) AS increase FROM windows
""")
def _(t):
    return S.increase(counters(t), "event_type", "15 minutes").select("event_id", "increase")


@plan("series_sums", "AGG-2 AGG-3", f"""
SELECT event_type, CAST(sum({_C}) AS BIGINT) AS total, max({_C}) AS top FROM events GROUP BY 1
""")
def _(t):
    c = counters(t)
    return S.agg_series(c, "sum", "event_type", out="total").join(S.agg_series(c, "max", "event_type", out="top"), "event_type")


@plan("series_total", "AGG-2", f"SELECT CAST(sum({_C}) AS BIGINT) AS total FROM events")
def _(t):
    return S.agg_series(counters(t), "sum", out="total")


@plan("average_by_label", "AGG-4 TOP-1", f"""
SELECT user_id, CAST(sum({_C}) AS DOUBLE) / count(*) AS avg_lag FROM events GROUP BY 1
""")
def _(t):
    return S.agg_series(counters(t), "avg", "user_id", out="avg_lag").orderBy(F.desc("avg_lag"))


@plan("count_with_predicate", "AGG-5", "SELECT event_type, count(*) FILTER (value > 80) AS failed FROM events GROUP BY 1")
def _(t):
    return S.count_series(t.events, F.col("value") > 80, "event_type", "failed")


@plan("count_by_label", "AGG-6", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return S.count_series(t.orders, by=["o_orderstatus", "o_orderpriority"])


@plan("distinct_counts", "AGG-7", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers,
  count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS big_customers FROM orders GROUP BY 1
""")
def _(t):
    a = S.count_distinct(t.orders, "o_custkey", by="o_orderstatus", out="customers")
    return a.join(S.count_distinct(t.orders, "o_custkey", F.col("o_totalprice") > 200000, "o_orderstatus", "big_customers"), "o_orderstatus")


@plan("latest_by_group", "AGG-8", """
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props
FROM events GROUP BY ALL
""")
def _(t):
    return S.latest(t.events, ["user_id", "event_type"], "ts", ["value", "props"], "event_id")


_BUCKETS = """
b AS (SELECT event_type, le, count(*) AS c FROM (SELECT event_type, unnest([10.0::DOUBLE, 25, 50, 75, 100, 'Infinity'::DOUBLE]) AS le, value FROM events)
      WHERE value <= le GROUP BY ALL)
"""


@plan("histogram_p95", "AGG-9", f"""
WITH {_BUCKETS},
o AS (SELECT *, lag(le) OVER w AS low, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS rank
      FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, arg_min(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ((rank - below) / (c - below)) END, le) AS quantile
FROM o WHERE c >= rank GROUP BY 1
""")
def _(t):
    bounds = F.array(*[F.lit(float(b)) for b in (10, 25, 50, 75, 100, "inf")])
    buckets = t.events.select("event_type", "value", F.explode(bounds).alias("le")).filter(F.col("value") <= F.col("le"))
    counted = buckets.groupBy("event_type", "le").agg(F.count("*").alias("value"))
    return S.histogram_quantile(counted, 0.95, "event_type")


def at_grid(source: str, by: str, step: int, seconds: int) -> str:
    """SQL of counters at a grid of times: samples joined with the points that look back on them."""
    return f"""
counters AS ({source}),
grown AS (SELECT *, CASE WHEN value >= lag(value) OVER s THEN value - lag(value) OVER s WHEN lag(value) OVER s IS NOT NULL THEN value ELSE 0 END AS step
          FROM counters WINDOW s AS (PARTITION BY {by} ORDER BY ts)),
totals AS (SELECT *, sum(step) OVER (PARTITION BY {by} ORDER BY ts) AS total FROM grown),
points AS (SELECT make_timestamp(k * {step} * 1000000::BIGINT) AS at_ FROM (SELECT unnest(range(
  epoch_us(min(ts)) // ({step} * 1000000::BIGINT), (epoch_us(max(ts)) + {seconds} * 1000000::BIGINT) // ({step} * 1000000::BIGINT) + 1)) AS k FROM counters)),
stepped AS (SELECT {by}, at_ AS "at", count(*) AS samples, arg_max(value, ts) AS last, CAST(CASE WHEN max(ts) > min(ts) THEN arg_max(total, ts) - arg_min(total, ts) END AS BIGINT) AS increase,
  CASE WHEN max(ts) > min(ts) THEN CAST(arg_max(total, ts) - arg_min(total, ts) AS DOUBLE) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6) END AS rate
  FROM points JOIN totals ON ts <= at_ AND ts > at_ - to_seconds({seconds}) GROUP BY {by}, at_)
"""


@plan("counters_at_steps", "TS-1 TS-2 TS-5", f"""
WITH {at_grid(_SAMPLES, 'user_id, event_type', 21600, 172800)}
SELECT user_id, event_type, "at", samples, last, increase, rate FROM stepped
""")
def _(t):
    return at_steps(counters(t), ["user_id", "event_type"], "6 hours", "2 days").drop("elapsed_us")


@plan("histogram_of_rates", "AGG-9 TS-1", f"""
WITH {at_grid(_SAMPLES, 'user_id', 86400, 172800)},
b AS (SELECT "at", u.le, sum(rate) AS c FROM stepped, (SELECT unnest([10.0::DOUBLE, 20, 30, 40, 50, 'Infinity'::DOUBLE]) AS le) u
      WHERE (user_id % 5 + 1) * 10 <= u.le AND rate IS NOT NULL GROUP BY ALL),
o AS (SELECT *, lag(le) OVER w AS low, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY "at") * 0.5::DOUBLE AS rank FROM b WINDOW w AS (PARTITION BY "at" ORDER BY le))
SELECT "at", round(arg_min(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ((rank - below) / (c - below)) END, le), 6) AS quantile
FROM o WHERE c >= rank GROUP BY "at"
""")
def _(t):
    rates = at_steps(counters(t), "user_id", "1 day", "2 days").filter("rate is not null")
    bounds = F.array(*[F.lit(float(b)) for b in (10, 20, 30, 40, 50, "inf")])
    own = (F.col("user_id") % 5 + 1) * 10.0
    buckets = rates.select("at", F.col("rate").alias("value"), F.explode(F.filter(bounds, lambda le: own <= le)).alias("le"))
    return S.histogram_quantile(buckets, 0.5, "at").withColumn("quantile", F.round("quantile", 6))


@plan("percentile_p95", "AGG-10", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def _(t):
    return S.percentile(t.lineitem, 0.95, "l_returnflag", "l_extendedprice", "p95")


@plan("utilisation", "AGG-11", """
WITH u AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
     m AS (SELECT o_custkey, count(*) AS most FROM orders GROUP BY 1)
SELECT o_custkey, n, most, CAST(n AS DOUBLE) / most * 100.0 AS percent FROM u JOIN m USING (o_custkey)
""")
def _(t):
    used = t.orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return S.ratio(used, t.orders.groupBy("o_custkey").agg(F.count("*").alias("most")), "o_custkey", "n", "most")


@plan("or_zero", "AGG-12 ALR-7", """
SELECT coalesce((SELECT count(*) FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1)
  WHERE state = 'error' HAVING count(*) > 0), 0) AS n
""")
def _(t):
    state = S.latest(t.events, "user_id", "ts", ["event_type"], "event_id")
    failed = state.filter("event_type = 'error'").groupBy("event_type").agg(F.count("*").alias("n"))
    return S.or_zero(failed, "n")


@plan("series_addition", "AGG-14", f"""
WITH a AS (SELECT user_id, CAST(sum({_C}) AS BIGINT) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
     b AS (SELECT user_id, CAST(sum({_C}) AS BIGINT) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, a.v + b.v AS value FROM a JOIN b USING (user_id)
""")
def _(t):
    c = counters(t)

    def total(kind):
        return S.agg_series(c.filter(F.col("event_type") == kind), "sum", "user_id", out="value")

    return S.add_series(total("click"), total("view"), "user_id")


@plan("reduce_last_max", "TS-5", """
SELECT user_id, arg_max(value, ts) AS last_value, max(value) AS max_value FROM events
WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1
""")
def _(t):
    now, events = datetime(2024, 1, 20), t.raw("events")
    last = S.reduce_last(events, "user_id", now, "10 days").withColumnRenamed("value", "last_value")
    return last.join(S.reduce_last(events, "user_id", now, "10 days", "max").withColumnRenamed("value", "max_value"), "user_id")


@plan("lag_in_seconds", "TS-6 JOIN-4", f"""
WITH {_pairs(_SAMPLES + " WHERE event_type <> 'error'", 'user_id', 86400)},
r AS (SELECT user_id, arg_max(CASE WHEN us > 0 THEN CAST(inc AS DOUBLE) / (CAST(us AS DOUBLE) / 1e6) END, ts) FILTER (us > 0) AS rate FROM windows GROUP BY 1),
l AS (SELECT user_id, max({_C}) AS value FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, value, rate, CASE WHEN rate <> 0 THEN value / rate END AS lag_seconds FROM l JOIN r USING (user_id) WHERE rate IS NOT NULL
""")
def _(t):
    c = counters(t)
    received = S.rate(c.filter("event_type <> 'error'"), "user_id", "1 day").filter("rate is not null")
    received = S.latest(received, "user_id", "ts", ["rate"])
    return S.lag_seconds(S.agg_series(c.filter("event_type = 'error'"), "max", "user_id", out="value"), received, "user_id")


@plan("progress_lag", "TS-7", """
SELECT event_id, epoch_us(TIMESTAMP '2024-02-01 00:00:00') / 1e6::DOUBLE - (epoch_us(ts) * 1000) / 1e9::DOUBLE AS progress_lag_s FROM events
""")
def _(t):
    marks = t.events.select("event_id", (F.unix_micros("ts") * 1000).alias("value"))
    return S.progress_lag(marks, datetime(2024, 2, 1)).select("event_id", "progress_lag_s")


def _last_rate(kind: str) -> str:
    """SQL of each user's last rate over a day of the counter of one kind of event."""
    return f"""(WITH {_pairs(_SAMPLES + f" WHERE event_type = '{kind}'", 'user_id', 86400)}
SELECT user_id, arg_max(CAST(inc AS DOUBLE) / (CAST(us AS DOUBLE) / 1e6), ts) AS rate FROM windows WHERE us > 0 GROUP BY 1)"""


@plan("throughput_in_out", "TS-9", f"""
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.rate AS in_per_s, b.rate AS out_per_s
FROM {_last_rate('click')} a FULL JOIN {_last_rate('view')} b ON a.user_id = b.user_id
""")
def _(t):
    def last_rate(kind):
        rates = S.rate(counters(t).filter(F.col("event_type") == kind), "user_id", "1 day").filter("rate is not null")
        return S.latest(rates, "user_id", "ts", ["rate"])

    return S.throughput(last_rate("click"), last_rate("view"), "user_id")


@plan("state_history", "TS-10", """
WITH m AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS was, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM m WHERE prev_ts IS NULL OR was <> event_type)
SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until, event_type FROM c
""")
def _(t):
    return S.state_history(t.events.select("user_id", "ts", "event_type", "event_id"), "user_id", "ts", "event_type", "event_id")


@plan("top_lag", "TOP-2", """
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL ORDER BY value DESC, user_id, event_type LIMIT 100
""")
def _(t):
    return S.top_lag(t.events, ["user_id", "event_type"], "ts", "value", 100, "event_id")


@plan("top_series", "TOP-3", """
SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1
ORDER BY o_totalprice DESC, o_custkey LIMIT 20
""")
def _(t):
    return S.top_series(t.orders, "o_custkey", 20, "o_orderdate", "o_totalprice", "o_orderkey")


@plan("dlq_rate", "DLQ-5", f"""
WITH c AS (SELECT event_id, 'database.dlq.' || event_type || '-' || user_id AS topic, ts, {_C} AS value FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT *, lag(value) OVER w AS was, lag(ts) OVER w AS before FROM c WHERE regexp_full_match(topic, 'database\\.dlq\\.error-.*') WINDOW w AS (PARTITION BY topic ORDER BY ts, event_id))
SELECT since, samples, records, CAST(records AS DOUBLE) / 86400.0 AS per_second FROM (
SELECT date_trunc('day', ts) AS since, count(*) AS samples, CAST(sum(CASE WHEN value >= was THEN value - was ELSE value END) AS BIGINT) AS records
FROM s WHERE before > ts - INTERVAL 1 DAY GROUP BY 1)
""")
def _(t):
    from tidemark.operators.errors import dlq_increase

    rows = counters(t).filter(F.col("event_type").isin("error", "signup")).withColumn(
        "topic", F.concat(F.lit("database.dlq."), "event_type", F.lit("-"), "user_id"))
    return dlq_increase(rows, r"database\.dlq\.error-.*", "1 day", "1 day")

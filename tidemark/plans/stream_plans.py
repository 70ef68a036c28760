"""Queries that run as streams over the given tables and return what the stream wrote."""

from datetime import datetime

from pyspark.sql import functions as F, types as T

from tidemark.operators.changes import dedupe_versions
from tidemark.operators.windows import amount_stats, tumbling, with_event_time
from tidemark.operators.alerts import Rule
from tidemark.plans.registry import plan
from tidemark.plans.window_plans import _AMOUNTS, _STATS
from tidemark.sources.topics import declare_stream, read_topic
from tidemark.streaming.alerts import alert_sustained_stream
from tidemark.streaming.days import DayTable
from tidemark.streaming.late import LateSplit
from tidemark.streaming.sealed import SealedTable
from tidemark.streaming.run import fed_in_parts, replayed, replayed_in_parts, run_stream, use_rocksdb
from tidemark.streaming.stateful import asof_join_stream, release_resolved_stream


def event_stream(t, **options):
    """The events table as a stream with event time."""
    raw = read_topic(t.spark, f"{t.folder}/events.parquet*", t.raw("events").schema, **options)
    return with_event_time(raw, "ts", "5 seconds")


def in_thirds(rows, time):
    """All rows in three batches that follow each other in time, cut at quantiles; rows without a time come first."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.percentile_approx(us, [1 / 3, 2 / 3]).alias("q")).first()["q"] or (0, 0)
    part = F.when(us > high, 2).when(us > low, 1).otherwise(0)
    return [rows.filter(part == i) for i in range(3)]


# Groups that users' state is kept in; each is small next to a task, and there are far fewer of them than users.
_GROUPS = 128

# The watermark trails the newest event by five seconds, at millisecond precision.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 SECOND FROM events)"


@plan("stream_read", "SRC-1 WM-4", "SELECT event_id, user_id, event_type, ts, value FROM events")
def _(t):
    out = event_stream(t, max_per_batch=1).select("event_id", "user_id", "event_type", "ts", "value")
    return replayed(out, "read")


@plan("stream_declared", "SRC-3 WM-1", "SELECT event_id, user_id, CAST(value AS DECIMAL(15,2)) AS value, ts FROM events")
def _(t):
    raw = read_topic(t.spark, f"{t.folder}/events.parquet*", t.raw("events").schema)
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
        T.StructField("value", T.DecimalType(15, 2)), T.StructField("ts", T.TimestampType()),
    ])
    return replayed(declare_stream(raw, schema, "ts", key=["event_id"]), "declared")


@plan("stream_tumbling_1h", "AGG-1 WM-1 WM-3", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {_STATS}
FROM {_AMOUNTS} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK} GROUP BY ALL
""")
def _(t):
    return replayed(tumbling(event_stream(t), "ts", "1 hour", amount_stats("value")), "tumbling")


@plan("stream_dedupe", "CDC-2", "SELECT event_id, ts, value FROM events")
def _(t):
    once = event_stream(t).select("event_id", "ts", "value")
    return replayed(dedupe_versions(once.unionByName(once), "event_id", "ts"), "dedupe")


# Two inputs: the slower watermark counts.
_ASOF_MARK = """(SELECT date_trunc('millisecond', min(m)) - INTERVAL 5 SECOND FROM
  (SELECT max(ts) AS m FROM events WHERE event_type IN ('purchase', 'view') GROUP BY event_type))"""


@plan("stream_asof", "JOIN-1 WM-1", f"""
SELECT p.event_id, p.user_id, p.ts, p.value, v.event_id AS profile_id, v.value AS rating
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
WHERE p.ts < {_ASOF_MARK}
""")
def _(t):
    use_rocksdb(t.spark)

    def side(kind):
        raw = read_topic(t.spark, f"{t.folder}/events.parquet*", t.raw("events").schema)
        return with_event_time(raw.filter(F.col("event_type") == kind), "ts", "5 seconds")

    left = side("purchase").select("event_id", "user_id", "ts", "value")
    right = side("view").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("profile_id"), F.col("value").alias("rating"))
    return replayed(asof_join_stream(left, right, "user_id", "ts", "since", order="profile_id", salts=4, width="10 days", groups=_GROUPS), "asof")


@plan("stream_resolved_gate", "CDC-3", """
SELECT event_id, user_id, ts FROM events e WHERE event_type <> 'signup'
  AND ts <= (SELECT max(ts) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id)
""")
def _(t):
    use_rocksdb(t.spark)
    events = event_stream(t)
    rows = events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    marks = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("resolved"))
    return replayed(release_resolved_stream(rows, marks, "ts", "resolved", "user_id", salts=4, width="10 days", groups=_GROUPS), "gate")


@plan("stream_resolved_gate_slowest", "CDC-3 WM-3", """
SELECT event_id, user_id % 4 AS shard, ts FROM events WHERE event_type <> 'signup'
  AND ts <= (SELECT min(m) FROM (SELECT max(ts) AS m FROM events WHERE event_type = 'signup' GROUP BY user_id % 4))
""")
def _(t):
    """The slowest of four feeds decides, over three runs of the stream."""
    use_rocksdb(t.spark)

    def gated(raw):
        rows = raw.filter("event_type <> 'signup'").select("event_id", "shard", "ts")
        marks = raw.filter("event_type = 'signup'").select("shard", F.col("ts").alias("resolved"))
        return release_resolved_stream(rows, marks, "ts", "resolved", "shard", salts=4, rule="slowest", feeds=list("0123"), width="1 day", groups=64)

    events = t.events.select("event_id", "event_type", (F.col("user_id") % 4).alias("shard"), "ts")
    return replayed_in_parts(in_thirds(events, "ts"), gated, "slowest")


# Every fiftieth event comes a third of the time too late.
_ARRIVAL = """SELECT event_id, ts, least(2, (epoch_us(ts) - lo) * 3 // (hi - lo + 1) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS part
  FROM events, (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)"""


@plan("stream_late_split", "WM-2 WM-3", f"""
WITH e AS ({_ARRIVAL}), m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 SECOND AS mark FROM e GROUP BY part)
SELECT event_id, ts, coalesce(ts < mark, false) AS late FROM e JOIN m USING (part)
""")
def _(t):
    rows = t.events.select("event_id", "ts")
    us = F.unix_micros("ts")
    ends = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    low, span = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    part = F.least(F.lit(2), F.expr(f"(unix_micros(ts) - {low}) * 3 div {span}") + (F.col("event_id") % 50 == 0).cast("int"))
    root = fed_in_parts(
        [rows.filter(part == i) for i in range(3)],
        lambda raw, at: run_stream(raw, LateSplit(f"{at}/split", "ts", "5 seconds"), f"{at}/checkpoint"), "late")
    return LateSplit(f"{root}/split", "ts", "5 seconds").read(t.spark, rows.schema)


_RULES = (
    Rule("value-warn", "value", "gt", 40.0, 3600, "warn"), Rule("value-alert", "value", "gt", 80.0, 3600, "alert"),
    Rule("value-low", "value", "lt", 25.0, 7200, "warn"),
)


@plan("stream_alerts_sustained", "ALR-2 ALR-3 ALR-4 ALR-9 WM-3", f"""
WITH rules(rule, op, lim, hold_s, severity) AS (VALUES ('value-warn', 'gt', 40.0, 3600, 'warn'), ('value-alert', 'gt', 80.0, 3600, 'alert'), ('value-low', 'lt', 25.0, 7200, 'warn')),
r AS (SELECT e.event_id, e.user_id, e.ts, e.value, rules.*, CASE op WHEN 'gt' THEN value > lim ELSE value < lim END AS breached FROM events e, rules),
m AS (SELECT *, lag(breached) OVER w AS was, lag(ts) OVER w AS prev_ts, lead(ts) OVER w AS next_ts FROM r WINDOW w AS (PARTITION BY rule, user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN prev_ts IS NULL OR NOT was OR ts - prev_ts > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS starts FROM m WHERE breached),
i AS (SELECT *, sum(starts) OVER (PARTITION BY rule, user_id ORDER BY ts, event_id) AS island FROM f),
n AS (SELECT *, min(ts) OVER p AS started, row_number() OVER o AS place, max(value) OVER o AS so_far, count(*) OVER p AS every,
  last_value(next_ts) OVER (PARTITION BY rule, user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS following
  FROM i WINDOW p AS (PARTITION BY rule, user_id, island), o AS (PARTITION BY rule, user_id, island ORDER BY ts, event_id)),
fired AS (SELECT * FROM n WHERE ts - started >= to_seconds(hold_s) QUALIFY row_number() OVER (PARTITION BY rule, user_id, island ORDER BY ts, event_id) = 1),
ended AS (SELECT * FROM n WHERE place = every AND ts - started >= to_seconds(hold_s) AND (following IS NOT NULL OR ts + INTERVAL 12 HOUR < {_MARK}))
SELECT rule, user_id, state, started, seen, place AS samples, so_far AS peak, severity, started + to_seconds(hold_s) AS fired_at
FROM (SELECT *, 'firing' AS state, ts AS seen FROM fired UNION ALL SELECT *, 'resolved', ts FROM ended)
""")
def _(t):
    use_rocksdb(t.spark)

    def alerts(raw):
        samples = with_event_time(raw, "ts", "5 seconds").withColumn("metric", F.lit("value"))
        return alert_sustained_stream(samples, _RULES, "user_id", max_gap="12 hours", order="event_id", groups=_GROUPS).drop("hold_s")

    rows = t.events.select("event_id", "user_id", "ts", "value")
    return replayed_in_parts(in_thirds(rows, "ts"), alerts, "alerts")


# Example master keys; a user passes keys fetched at run time.
_OLD_MASTERS, _NEW_MASTERS = ({f"team-{i}": bytes([i + first]) * 32 for i in range(3)} for first in (1, 101))


@plan("stream_sealed", "PII-3 PII-1 SNK-5", """
SELECT event_id, event_type, event_type AS before_rotation, octet_length(encode(event_type)) + 28 AS sealed_bytes FROM events
""")
def _(t):
    """Ciphertext through a stream's sink; keys are wrapped anew, then rows are opened with the old and the new master keys."""
    rows = t.events.select("event_id", "ts", "event_type", F.concat(F.lit("team-"), F.col("user_id") % 3).alias("key_id"))
    root = fed_in_parts(
        in_thirds(rows, "ts"), lambda raw, at: run_stream(raw, SealedTable(f"{at}/sealed", ["event_type"], _OLD_MASTERS), f"{at}/checkpoint"), "sealed")
    table = SealedTable(f"{root}/sealed", ["event_type"], _OLD_MASTERS)
    table.rewrap(t.spark, _NEW_MASTERS)
    new = table.opened(t.spark, rows.schema, _NEW_MASTERS).select("event_id", "event_type")
    old = table.opened(t.spark, rows.schema, _OLD_MASTERS, generation=0).select("event_id", F.col("event_type").alias("before_rotation"))
    sizes = table.sealed(t.spark, rows.schema).select("event_id", F.octet_length("event_type").cast("long").alias("sealed_bytes"))
    return new.join(old, "event_id").join(sizes, "event_id")


@plan("stream_retention", "RET-1 SNK-7", """
SELECT event_id, ts, tier FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'standard' WHEN 2 THEN 'best-effort' ELSE 'compliance' END AS tier FROM events)
WHERE epoch_ms(TIMESTAMP '2024-01-29 18:30:00') - epoch_ms(ts) <=
  CASE tier WHEN 'critical' THEN 604800000 WHEN 'standard' THEN 259200000 WHEN 'best-effort' THEN 86400000 ELSE 7 * 31557600000 END
""")
def _(t):
    """Days of a stream's table that are over for their tier are dropped as folders; the day on the edge is written again."""
    tier = F.element_at(F.array(*map(F.lit, ("critical", "standard", "best-effort", "compliance"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = t.events.select("event_id", "ts", tier.alias("tier"))
    root = fed_in_parts(in_thirds(rows, "ts"), lambda raw, at: run_stream(raw, DayTable(f"{at}/days", "ts", "tier"), f"{at}/checkpoint"), "retention")
    table = DayTable(f"{root}/days", "ts", "tier")
    table.expire(t.spark, rows.schema, datetime(2024, 1, 29, 18, 30), 7)
    return table.read(t.spark, rows.schema)

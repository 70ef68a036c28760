from pyspark.sql import functions as F, types as T

from tidemark.operators import errors as E
from tidemark.plans.registry import plan

_PAYLOADS = """(SELECT 'e' || event_id AS id, props AS value FROM events UNION ALL SELECT 'd' || doc_id, text FROM documents)"""


def payloads(t):
    """Event payloads, which are JSON, and document texts, most of which are not."""
    return t.events.select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("value")).unionByName(
        t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("value"))
    )


PAYLOAD = T.StructType([T.StructField("k", T.IntegerType())])


@plan("dlq_split", "DLQ-1", f"""
SELECT id, CASE WHEN ok THEN CAST(json_extract(value, '$.k') AS INTEGER) END AS k, CASE WHEN ok THEN 'good' ELSE 'bad' END AS side
FROM (SELECT *, coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' END, false) AS ok FROM {_PAYLOADS})
""")
def _(t):
    good, bad = E.split_decodable(payloads(t), PAYLOAD)
    return good.select("id", F.col("decoded.k").alias("k"), F.lit("good").alias("side")).unionByName(
        bad.select("id", F.lit(None).cast("int").alias("k"), F.lit("bad").alias("side"))
    )


_CODE = """CASE event_type WHEN 'error' THEN '_VALUE_DESERIALIZATION' WHEN 'click' THEN 'TOPIC_AUTHORIZATION_FAILED'
  WHEN 'view' THEN 'REQUEST_TIMED_OUT' ELSE 'OTHER' END"""
_MESSAGE = "CASE WHEN value > 60 THEN 'Schema is INCOMPATIBLE with ' ELSE 'failed on ' END || props || repeat('x', CAST(value AS INTEGER) * 20)"
_CATEGORY = """CASE event_type WHEN 'error' THEN 'SERIALIZATION' WHEN 'click' THEN 'AUTH_DENIED' WHEN 'view' THEN 'BROKER_TIMEOUT'
  ELSE CASE WHEN value > 60 THEN 'SCHEMA_INCOMPATIBLE' ELSE 'UNKNOWN' END END"""


def failures(t):
    kind = F.col("event_type")
    code = (F.when(kind == "error", "_VALUE_DESERIALIZATION").when(kind == "click", "TOPIC_AUTHORIZATION_FAILED")
            .when(kind == "view", "REQUEST_TIMED_OUT").otherwise("OTHER"))
    start = F.when(F.col("value") > 60, "Schema is INCOMPATIBLE with ").otherwise("failed on ")
    padding = F.repeat(F.lit("x"), F.rint("value").cast("int") * 20)
    return t.events.withColumns({"code": code, "message": F.concat(start, "props", padding), "attempt": (F.col("user_id") % 5).cast("int")})


@plan("error_categories", "DLQ-2", f"SELECT event_id, {_CATEGORY} AS category FROM events")
def _(t):
    return failures(t).select("event_id", E.classify_error("code", "message").alias("category"))


@plan("retry_plan", "DLQ-3", """
SELECT event_id, CASE WHEN again THEN 'retry' ELSE 'dead_letter' END AS action, CASE WHEN again THEN pow(2.0::DOUBLE, user_id % 5) END AS backoff_s
FROM (SELECT *, event_type NOT IN ('error', 'click') AND user_id % 5 < 3 AS again FROM events)
""")
def _(t):
    return failures(t).select("event_id", E.plan_retry("code", "attempt").alias("p")).select("event_id", "p.*")


@plan("dlq_envelope", "DLQ-4", f"""
SELECT event_id, 'bank.' || event_type || '.dlq' AS dlq_topic, 'bank.' || event_type AS topic, {_CATEGORY} AS category,
  substr({_MESSAGE}, 1, 1024) AS message, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at,
  CAST(user_id % 5 AS VARCHAR) AS retries, 'app-dlq' AS client
FROM events
""")
def _(t):
    rows = E.dlq_envelope(
        failures(t), F.concat(F.lit("bank."), "event_type"), F.col("code"), F.col("message"), F.col("ts"), F.col("attempt"), "app"
    )
    h = F.col("headers")
    return rows.select(
        "event_id", "dlq_topic", h["dlq.original.topic"].alias("topic"), h["dlq.error.type"].alias("category"),
        h["dlq.error.message"].alias("message"), h["dlq.timestamp"].alias("at"), h["dlq.retry.count"].alias("retries"),
        h["dlq.producer.client.id"].alias("client"),
    )


def refuse_large(key, value) -> None:
    """Handler of the example: fails on large values."""
    if value > 60:
        raise ValueError(f"value of {key} too large")


@plan("record_handler", "DLQ-6 UDF-1", """
SELECT event_id, value <= 60 AS handled, CASE WHEN value > 60 THEN 'ValueError: value of ' || event_id || ' too large' END AS error FROM events
""")
def _(t):
    out = E.foreach_record(t.events.select("event_id", "value"), refuse_large, "event_id", "value")
    return out.select("event_id", "handled", "error")


@plan("run_counters", "REC-4", """
SELECT count(*) AS consumed, count(*) FILTER (event_type IN ('click', 'view')) AS sent, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'signup') AS dead_lettered FROM events
""")
def _(t):
    from tidemark.operators.reconcile import run_counters

    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), "sent").when(kind == "error", "error").when(kind == "signup", "dead_letter")
    return run_counters(t.events.select(status.alias("status")))

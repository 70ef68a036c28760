from datetime import datetime

from pyspark.sql import functions as F, types as T

from tidemark.operators.changes import snapshot_then_changes
from tidemark.operators.routing import select_topics
from tidemark.functions.units import instant
from tidemark.plans.registry import plan
from tidemark.session import fresh_path
from tidemark.sources.changes import flatten_change, flatten_document_change, poll_increment, read_changefeed, replay_from
from tidemark.sources.schemas import schema_from_avsc
from tidemark.sources.telemetry import read_audit, read_metrics, to_samples
from tidemark.sources.topics import decode_values


@plan("decode_payloads", "SRC-2", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
""")
def _(t):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    good, _bad = decode_values(t.events.select("event_id", F.col("props").alias("value")), schema)
    return good


EVENT = """{"type": "record", "name": "Event", "namespace": "org.example.shop", "fields": [
  {"name": "event_type", "type": {"type": "enum", "name": "EventType", "symbols": ["click", "error", "purchase", "signup", "view"]}},
  {"name": "event_id", "type": "long"},
  {"name": "user", "type": "string", "doc": "PII"},
  {"name": "on_day", "type": {"type": "int", "logicalType": "date"}},
  {"name": "seen", "type": {"type": "long", "logicalType": "timestamp-millis"}},
  {"name": "channel", "type": "string", "default": "web"},
  {"name": "score", "type": ["null", {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}], "default": null}]}"""


def sent_events(t):
    """Events as their schema sends them: times as milliseconds, dates as days; one in seven lacks what it needs."""
    odd = F.col("event_id") % 21
    return t.events.select("event_id", F.to_json(F.struct(
        F.when(odd == 7, "refund").otherwise(F.col("event_type")).alias("event_type"), "event_id",
        F.when(odd != 14, F.col("user_id").cast("string")).alias("user"), F.unix_date(F.to_date("ts")).alias("on_day"),
        F.when(odd == 0, F.lit("soon")).otherwise(F.unix_millis("ts").cast("string")).alias("seen"),
        F.when(F.col("event_type") == "click", "app").alias("channel"), F.when(F.col("value") > 60, F.col("value")).alias("score"),
    )).alias("value"))


@plan("typed_contract", "SRC-4 SRC-2", """
SELECT event_type, event_id, CAST(user_id AS VARCHAR) AS user, CAST(ts AS DATE) AS on_day, date_trunc('millisecond', ts) AS seen,
  CASE WHEN event_type = 'click' THEN 'app' ELSE 'web' END AS channel, CASE WHEN value > 60 THEN CAST(value AS DECIMAL(12,2)) END AS score
FROM events WHERE event_id % 7 <> 0
""")
def _(t):
    good, _bad = decode_values(sent_events(t).select("value"), schema_from_avsc(EVENT))
    return good


@plan("typed_contract_bad", "SRC-4 DLQ-1", """
SELECT event_id, CASE event_id % 21 WHEN 7 THEN 'symbol' WHEN 14 THEN 'required' ELSE 'time' END AS fault FROM events WHERE event_id % 7 = 0
""")
def _(t):
    _good, bad = decode_values(sent_events(t), schema_from_avsc(EVENT))
    body = F.from_json("value", "event_type string, user string")
    fault = F.when(body["event_type"] == "refund", "symbol").when(body["user"].isNull(), "required").otherwise("time")
    return bad.select("event_id", fault.alias("fault"))


@plan("poll_increment", "SRC-5", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderdate > TIMESTAMP '1999-03-01' OR (o_orderdate = TIMESTAMP '1999-03-01' AND o_orderkey > 500)
""")
def _(t):
    rows, _next = poll_increment(t.raw("orders"), "o_orderdate", "o_orderkey", {"ts": datetime(1999, 3, 1), "id": 500})
    return rows.select("o_orderkey", "o_custkey", "o_orderdate")


@plan("poll_position", "SRC-5", "SELECT max(o_orderdate) AS ts, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders")
def _(t):
    return poll_increment(t.raw("orders"), "o_orderdate", "o_orderkey")[1]


@plan("flatten_change", "SRC-6", """
SELECT o_orderkey, o_custkey, o_totalprice + CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS price, o_orderstatus = 'F' AS deleted FROM orders
UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'F'
""")
def _(t):
    status = F.col("o_orderstatus")
    before = F.struct("o_custkey", F.col("o_totalprice").alias("price"))
    after = F.struct("o_custkey", (F.col("o_totalprice") + 1).alias("price"))
    op = F.when(status == "O", "c").when(status == "P", "u").otherwise("d")
    events = t.orders.select("o_orderkey", op.alias("op"), F.when(status != "O", before).alias("before"), F.when(status != "F", after).alias("after"))
    tombstones = events.filter("op = 'd'").select("o_orderkey")
    return flatten_change(events.unionByName(tombstones, allowMissingColumns=True))


@plan("flatten_documents", "SRC-7", """
SELECT 'c' || c_custkey AS document_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'delete' WHEN 'MACHINERY' THEN 'insert' ELSE 'update' END AS operation,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance,
  c_mktsegment = 'BUILDING' AS deleted FROM customer
""")
def _(t):
    seg = F.col("c_mktsegment")
    doc_id = F.concat(F.lit("c"), "c_custkey")
    whole = F.struct(doc_id.alias("_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    events = t.customer.select(
        F.when(seg == "BUILDING", "delete").when(seg == "MACHINERY", "insert").otherwise("update").alias("operation"),
        F.when(seg != "BUILDING", whole).alias("full_document"), F.struct(doc_id.alias("_id")).alias("document_key"),
    )
    return flatten_document_change(events)


@plan("read_changefeed", "SRC-8", """
SELECT 'row' AS kind, event_id, user_id, ts AS at, event_type = 'error' AS deleted FROM events WHERE event_type <> 'signup'
UNION ALL SELECT 'resolved', NULL, NULL, ts, NULL FROM events WHERE event_type = 'signup'
""")
def _(t):
    kind = F.col("event_type")
    state = F.struct("event_id", "user_id")
    messages = t.events.select(
        F.when(kind.isin("error", "view"), state).alias("before"), F.when(~kind.isin("error", "signup"), state).alias("after"),
        F.when(kind != "signup", F.col("ts")).alias("updated"), F.when(kind == "signup", F.col("ts")).alias("resolved"),
    )
    data, resolved = read_changefeed(messages)
    rows = data.select(F.lit("row").alias("kind"), "event_id", "user_id", F.col("updated").alias("at"), "deleted")
    marks = resolved.select(F.lit("resolved").alias("kind"), F.col("resolved").alias("at"))
    return rows.unionByName(marks, allowMissingColumns=True)


@plan("replay_from", "SRC-9", "SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def _(t):
    raw = t.raw("events")
    cursor = instant(datetime(2024, 1, 15, 12)).cast(raw.schema["ts"].dataType)
    return replay_from(raw, "ts", cursor).select("event_id", "user_id", "ts")


@plan("snapshot_then_changes", "SRC-10", """
SELECT id, version, status FROM (SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status,
  arg_max(o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-06-01', o_orderkey) AS gone FROM orders GROUP BY 1) WHERE NOT gone
""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    early = rows.filter("o_orderdate < TIMESTAMP '1999-01-01 00:00:00'").drop("o_orderdate")
    snapshot = early.groupBy("id").agg(F.max("version").alias("version"), F.max_by("status", "version").alias("status"))
    later = rows.filter("o_orderdate >= TIMESTAMP '1998-06-01 00:00:00'").drop("o_orderdate")
    changes = later.unionByName(later).withColumn("deleted", F.col("status") == "F")
    return snapshot_then_changes(snapshot, changes, "id", "version")


@plan("select_topics", "SRC-11", """
SELECT doc_id, source || '.' || lang AS topic FROM documents
WHERE regexp_full_match(source || '.' || lang, 'src[0-9]\\..*|src1[0-5]\\..*') AND NOT regexp_full_match(source || '.' || lang, '.*\\.de|src7\\..*')
""".replace("\\\\", "\\"))
def _(t):
    named = t.documents.select("doc_id", F.concat_ws(".", "source", "lang").alias("topic"))
    return select_topics(named, [r"src[0-9]\..*", r"src1[0-5]\..*"], [r".*\.de", r"src7\..*"])


@plan("read_metrics", "SRC-12", """
SELECT 'lag' AS metric, CAST(user_id AS VARCHAR) AS topic, event_type AS state, ts, value FROM events
""")
def _(t):
    path = fresh_path(t.spark, "metrics")
    rows = t.events.select(F.col("user_id").cast("string").alias("topic"), F.col("event_type").alias("state"), "ts", "value")
    to_samples(rows, "lag", "ts", "value", ["topic", "state"]).write.parquet(path)
    return read_metrics(t.spark, path).select("metric", "topic", "state", "ts", "value")


@plan("read_audit", "SRC-13", """
SELECT CAST(event_id AS VARCHAR) AS id, ts, CASE event_type WHEN 'error' THEN 'authentication' WHEN 'click' THEN 'schema' ELSE 'other' END AS kind,
  'User:' || user_id AS principal FROM events
""")
def _(t):
    path = fresh_path(t.spark, "audit")
    kind = F.col("event_type")
    event = F.when(kind == "error", "authentication.failure").when(kind == "click", "schema.hard_delete").otherwise(F.concat(F.lit("x."), kind))
    rows = t.events.select(F.col("event_id").cast("string").alias("id"), "ts", event.alias("event"), F.concat(F.lit("User:"), "user_id").alias("principal"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return read_audit(t.spark, path).select("id", "ts", "kind", "principal")


@plan("sql_statement", "UDF-3", """
SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1
""")
def _(t):
    from tidemark.statements import run_statement

    return run_statement(
        t.spark, "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey "
        "WHERE c_mktsegment = 'BUILDING' GROUP BY 1", {"orders": t.orders, "customer": t.customer},
    )

from pyspark.sql import functions as F

from tidemark.functions import (
    connector_name,
    dead_letter_topic,
    duration_text,
    lakehouse_connector_name,
    map_topic,
    route_topic,
    split_target,
    subject_name,
    table_name,
    years_to_millis,
)
from tidemark.operators.routing import extract_field, match_labels, mirror, route, union_normalized
from tidemark.plans.registry import plan


@plan("select_filter", "PRJ-1 PRJ-2", """
SELECT e.event_id AS transaction_id, e.user_id AS account, e.value AS amount FROM events e
WHERE e.value > 20 AND e.value <= 90 AND e.event_type = 'purchase'
""")
def _(t):
    e = t.events.alias("e")
    return e.filter((F.col("e.value") > 20) & (F.col("e.value") <= 90) & (F.col("e.event_type") == "purchase")).select(
        F.col("e.event_id").alias("transaction_id"), F.col("e.user_id").alias("account"), F.col("e.value").alias("amount")
    )


@plan("label_filters", "PRJ-3", """
SELECT doc_id, source, lang FROM documents
WHERE lang = 'en' AND regexp_full_match(source, 'src1[0-9]|src[2-5]') AND starts_with(source, 'src1')
""")
def _(t):
    kept = match_labels(t.documents, {"lang": "en"}, {"source": "src1[0-9]|src[2-5]"}, {"source": "src1"})
    return kept.select("doc_id", "source", "lang")


@plan("route_split", "RTE-1", """
SELECT event_id, score, CASE WHEN score >= 85 THEN 'high' ELSE 'low' END AS route
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS score FROM events) WHERE score IS NOT NULL
""")
def _(t):
    scored = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return route(scored, {"high": F.col("score") >= 85, "low": F.col("score") < 85})


@plan("route_overlap", "RTE-2", """
SELECT o_orderkey, 'high_value' AS route FROM orders WHERE o_totalprice > 100000
UNION ALL
SELECT o_orderkey, 'flagged' AS route FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000
""")
def _(t):
    price = F.col("o_totalprice")
    routes = {"high_value": price > 100000, "flagged": (F.col("o_orderpriority") == "1-URGENT") & (price > 200000)}
    return route(t.orders, routes).select("o_orderkey", "route")


@plan("topic_router", "RTE-3", r"""
SELECT doc_id, CASE WHEN regexp_full_match(topic, 'db1\.banking\.(.+)')
  THEN regexp_replace(topic, '^db1\.banking\.(.+)$', 'core.transactions.v1.\1') ELSE topic END AS topic
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'db1.banking.' ELSE 'other.banking.' END || source AS topic FROM documents)
""")
def _(t):
    start = F.when(F.col("lang") == "en", "db1.banking.").otherwise("other.banking.")
    named = t.documents.select("doc_id", F.concat(start, F.col("source")).alias("topic"))
    return named.withColumn("topic", route_topic("topic", r"db1\.banking\.(.+)", "core.transactions.v1.$1"))


@plan("topic_table_map", "RTE-4", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'PURCHASES' WHEN 'error' THEN 'ERRORS' ELSE event_type END AS target
FROM events
""")
def _(t):
    return t.events.select("event_id", map_topic("event_type", {"purchase": "PURCHASES", "error": "ERRORS"}).alias("target"))


@plan("derived_names", "RTE-5 SNK-9", """
WITH n AS (SELECT p_partkey, lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' AS topic, p_brand AS brand FROM part)
SELECT p_partkey, 'database-postgres-sink-' || rtrim(replace(topic, '.', '-'), '-') AS connector,
  'lakehouse-' || lower(brand) || '-' || topic AS lake_connector,
  'lakehouse.dlq.lakehouse-' || lower(brand) || '-' || topic AS dead_letters,
  replace(topic, '.', '_') AS table_name, split_part(topic, '.', 1) AS catalog, split_part(topic, '.', 2) AS schema_name,
  split_part(topic, '.', 3) AS table_part
FROM n
""")
def _(t):
    named = t.part.select(
        "p_partkey", F.concat_ws(".", F.lower("p_type"), F.translate("p_name", " ", "."), F.lit("")).alias("topic"), "p_brand"
    )
    lake = lakehouse_connector_name("p_brand", "topic")
    target = split_target("topic")
    return named.select(
        "p_partkey", connector_name(F.lit("postgres"), "sink", "topic").alias("connector"), lake.alias("lake_connector"),
        dead_letter_topic("lakehouse", lake).alias("dead_letters"), table_name("topic").alias("table_name"),
        target["catalog"].alias("catalog"), target["schema"].alias("schema_name"), target["table"].alias("table_part"),
    )


@plan("extracted_key", "RTE-6", "SELECT event_id, json_extract_string(props, '$.k') AS key FROM events")
def _(t):
    parsed = t.events.select("event_id", F.from_json("props", "k int").alias("value"))
    return extract_field(parsed, "value.k").select("event_id", "key")


@plan("mirror_topics", "SNK-10 SRC-11", """
SELECT doc_id, 'east.' || topic AS topic
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN source || '.v1' WHEN 'de' THEN '__' || source ELSE source || '.internal' END AS topic
      FROM documents)
WHERE NOT regexp_full_match(topic, '.*\\.internal|.*\\.replica|__.*')
""".replace("\\\\", "\\"))
def _(t):
    source = F.col("source")
    topic = (
        F.when(F.col("lang") == "en", F.concat(source, F.lit(".v1")))
        .when(F.col("lang") == "de", F.concat(F.lit("__"), source))
        .otherwise(F.concat(source, F.lit(".internal")))
    )
    return mirror(t.documents.select("doc_id", topic.alias("topic")), "east")


@plan("union_normalized", "SET-2", """
SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name, NULL FROM nation
""")
def _(t):
    parts = [
        t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
    ]
    return union_normalized(parts, {"kind": "string", "id": "string", "name": "string", "segment": "string"})


@plan("subject_names", "GOV-4", """
WITH n AS (SELECT c_custkey, 'org.example.' || lower(c_mktsegment) || '.nation' || c_nationkey || '.v' || (c_custkey % 3 + 1) AS ns,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'AccountTransaction' WHEN 'MACHINERY' THEN 'MemberUpdate' ELSE 'Balance' END AS rec
  FROM customer)
SELECT c_custkey, substr(ns, length('org.example.') + 1) || '.' ||
  CASE rec WHEN 'AccountTransaction' THEN 'account-transaction' WHEN 'MemberUpdate' THEN 'member-update' ELSE 'balance' END || '-value' AS subject
FROM n
""")
def _(t):
    ns = F.concat(F.lit("org.example."), F.lower("c_mktsegment"), F.lit(".nation"), F.col("c_nationkey"), F.lit(".v"),
                  F.col("c_custkey") % 3 + 1)
    rec = (F.when(F.col("c_mktsegment") == "BUILDING", "AccountTransaction")
           .when(F.col("c_mktsegment") == "MACHINERY", "MemberUpdate").otherwise("Balance"))
    return t.customer.select("c_custkey", subject_name(ns, rec).alias("subject"))


@plan("unit_conversions", "TS-8 TS-3", """
SELECT event_id, user_id * 1000 / 1000.0::DOUBLE AS seconds, event_id // 1000 AS whole_seconds, event_id / 1e6::DOUBLE AS millis,
  event_id / 1048576.0::DOUBLE AS megabytes, value * 60.0 AS per_minute,
  CASE WHEN event_id // 3600 > 0 THEN (event_id // 3600) || 'h ' || (event_id % 3600 // 60) || 'm'
       WHEN event_id % 3600 // 60 > 0 THEN (event_id % 3600 // 60) || 'm ' || (event_id % 60) || 's'
       ELSE (event_id % 60) || 's' END AS duration,
  CASE WHEN user_id % 7 = 0 THEN -1 ELSE (user_id % 7) * 31557600000 END AS retention_ms
FROM events
""")
def _(t):
    from tidemark.functions import bytes_to_megabytes, millis_to_seconds, nanos_to_millis, per_minute

    years = F.when(F.col("user_id") % 7 == 0, -1).otherwise(F.col("user_id") % 7)
    return t.events.select(
        "event_id", millis_to_seconds(F.col("user_id") * 1000).alias("seconds"),
        millis_to_seconds("event_id", whole=True).alias("whole_seconds"), nanos_to_millis("event_id").alias("millis"),
        bytes_to_megabytes("event_id").alias("megabytes"), per_minute("value").alias("per_minute"),
        duration_text("event_id").alias("duration"), years_to_millis(years).alias("retention_ms"),
    )

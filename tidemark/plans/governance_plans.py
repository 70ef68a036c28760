from pyspark.sql import functions as F

from tidemark.functions import effective_settings
from tidemark.operators import governance as G
from tidemark.plans.join_plans import _TIER, binding_topics, order_tier
from tidemark.plans.registry import plan
from tidemark.session import dealt, durable

_PARTS = """
parts AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS domain,
  CASE WHEN c_nationkey = 3 THEN '' ELSE 'app-' || c_nationkey END AS application,
  CASE WHEN c_nationkey = 5 THEN '1' ELSE 'v' || (c_custkey % 4) END AS version,
  CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey = 8 THEN repeat('long-', 20) ELSE lower(replace(c_name, '#', '-')) END AS entity FROM customer)
"""


def name_parts(t):
    n = F.col("c_nationkey")
    return t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("domain"),
        F.when(n == 3, "").otherwise(F.concat(F.lit("app-"), n)).alias("application"),
        F.when(n == 5, "1").otherwise(F.concat(F.lit("v"), F.col("c_custkey") % 4)).alias("version"),
        F.when(n == 7, F.lit(None)).when(n == 8, F.repeat(F.lit("long-"), F.lit(20)))
        .otherwise(F.lower(F.translate("c_name", "#", "-"))).alias("entity"),
    )


def _part_errors(empty_is_missing: bool) -> str:
    rules = (("domain", "[a-z][a-z0-9-]{1,30}"), ("application", "[a-z][a-z0-9-]{1,30}"), ("version", "v[0-9]+"), ("entity", "[a-z][a-z0-9-]{1,60}"))
    out = []
    for name, rule in rules:
        missing = f"WHEN {name} IS NULL OR {name} = '' THEN '{name} is missing' " if empty_is_missing else ""
        out.append(f"CASE {missing}WHEN NOT regexp_full_match({name}, '{rule}') THEN '{name} ''' || {name} || ''' is invalid' END")
    return "concat_ws('; ', " + ", ".join(out) + ")"


@plan("check_name_parts", "GOV-1 UDF-2", f"""
WITH {_PARTS}, e AS (SELECT *, {_part_errors(True)} AS errors FROM parts)
SELECT c_custkey, errors, errors = '' AS passed, CASE WHEN errors = '' THEN concat_ws('.', domain, application, version, entity) END AS topic FROM e
""")
def _(t):
    return G.check_parts(name_parts(t)).select("c_custkey", F.array_join("errors", "; ").alias("errors"), "passed", "topic")


@plan("check_whole_names", "GOV-1 UDF-2", f"""
WITH {_PARTS}, n AS (SELECT c_custkey, concat_ws('.', domain, application, version, entity) AS topic FROM parts),
s AS (SELECT c_custkey, topic, len(string_split(topic, '.')) AS k, split_part(topic, '.', 1) AS domain, split_part(topic, '.', 2) AS application,
  split_part(topic, '.', 3) AS version, split_part(topic, '.', 4) AS entity FROM n)
SELECT c_custkey, CASE WHEN k <> 4 THEN 'expected 4 parts, got ' || k ELSE {_part_errors(False)} END AS errors FROM s
""")
def _(t):
    whole = name_parts(t).select("c_custkey", F.concat_ws(".", "domain", "application", "version", "entity").alias("topic"))
    return G.check_names(whole).select("c_custkey", F.array_join("errors", "; ").alias("errors"))


def documents(t):
    """Schema documents derived from customers; some lack parts or are not JSON."""
    n, quote = F.col("c_nationkey"), F.col("c_mktsegment")
    kind = F.when(n == 1, "enum").otherwise("record")
    ns = F.when(n == 2, "").when(n == 3, F.concat(F.lit("com.example."), F.lower(quote))).otherwise(
        F.concat(F.lit("org.example."), F.lower(quote), F.lit(".app"), n, F.lit(".v1")))
    fields = (
        F.when(n == 4, "[]").when(n == 5, '[{"type":"string"}]').when(n == 6, '[{"name":"a"}]')
        .otherwise('[{"name":"member_name","type":"string","doc":"PII"},{"name":"amount","type":["null","long"],"default":null},'
                   '{"name":"kind","type":{"type":"enum","name":"K","symbols":["A","B"]}}]')
    )
    text = F.concat(
        F.lit('{"type":"'), kind, F.lit('","name":"'), F.translate("c_name", "#", ""), F.lit('","namespace":"'), ns,
        F.lit('","fields":'), fields, F.when(n == 9, "").otherwise("}"),
    )
    return t.customer.select("c_custkey", "c_nationkey", text.alias("document"))


@plan("check_schemas", "GOV-2 GOV-3", """
SELECT c_custkey, CASE c_nationkey WHEN 1 THEN 'type must be record' WHEN 2 THEN 'missing namespace' WHEN 3 THEN 'namespace does not match'
  WHEN 4 THEN 'missing or empty fields' WHEN 5 THEN 'field without name' WHEN 6 THEN 'field without type' WHEN 9 THEN 'invalid JSON' ELSE '' END AS errors
FROM customer
""")
def _(t):
    return G.check_schemas(documents(t), "org.example").select("c_custkey", F.array_join("errors", "; ").alias("errors"))


@plan("pii_inventory", "PII-4", """
SELECT c_custkey, 'member_name' AS field FROM customer WHERE c_nationkey NOT IN (4, 5, 6, 9)
""")
def _(t):
    from tidemark.operators.privacy import pii_inventory

    return pii_inventory(documents(t)).select("c_custkey", "field")


@plan("schema_field_rows", "SRC-4 GOV-5", """
WITH f(field, type, has_default, symbols) AS (VALUES ('member_name', 'string', false, NULL), ('amount', '["null","long"]', true, NULL),
  ('kind', '{"type":"enum","name":"K","symbols":["A","B"]}', false, 'A,B'))
SELECT c_custkey, field, type, has_default, symbols FROM customer, f WHERE c_nationkey NOT IN (4, 5, 6, 9)
""")
def _(t):
    whole = documents(t).filter(~F.col("c_nationkey").isin(4, 5, 6, 9))
    return G.schema_fields(whole).select("c_custkey", "field", "type", "has_default", F.array_join("symbols", ",").alias("symbols"))


def field_versions(t):
    """Each customer is a subject, each order one of its schema versions, each line item a field of it."""
    versions = t.orders.select("o_orderkey", F.col("o_custkey").alias("subject"))
    items = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.ascii("l_returnflag").alias("flag"), F.ascii("l_linestatus").alias("status"))
    fields = dealt(items, t.lineitem.count(), "o_orderkey").join(versions, "o_orderkey").groupBy("subject", "o_orderkey", "l_linenumber").agg(
        F.chr(F.max("flag")).alias("flag"), F.chr(F.max("status")).alias("status"))
    kind = F.when(F.col("flag") == "A", "int").when(F.col("flag") == "N", "long").otherwise("string")
    rows = fields.select(
        "subject", F.col("o_orderkey").alias("version"), F.concat(F.lit("f"), "l_linenumber").alias("field"), kind.alias("type"),
        (F.col("status") == "O").alias("has_default"))
    return durable(rows, "field-versions")


_FIELDS = """
f AS (SELECT o_custkey AS subject, o_orderkey AS version, 'f' || l_linenumber AS field,
  CASE max(l_returnflag) WHEN 'A' THEN 'int' WHEN 'N' THEN 'long' ELSE 'string' END AS type, max(l_linestatus) = 'O' AS has_default
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT subject, version, lag(version) OVER (PARTITION BY subject ORDER BY version) AS previous FROM (SELECT DISTINCT subject, version FROM f))
"""


def _compat(pairs: str, back: bool, fwd: bool) -> str:
    """SQL of the compatibility check, comparing each version with the writers in ``pairs``, from the rules as stated."""
    broken = " OR ".join(["(back AND %s)" % str(back).lower(), "(fwd AND %s)" % str(fwd).lower()])
    return f"""
WITH {_FIELDS}, p AS ({pairs}),
added AS (SELECT p.subject, p.version, count(DISTINCT n.field) AS k FROM p JOIN f n ON n.subject = p.subject AND n.version = p.version
  WHERE NOT n.has_default AND NOT EXISTS (SELECT 1 FROM f o WHERE o.subject = p.subject AND o.version = p.writer AND o.field = n.field) GROUP BY ALL),
typed AS (SELECT subject, version, count(DISTINCT field) FILTER ({broken}) AS k
  FROM (SELECT p.*, n.field, o.type <> n.type AND NOT (n.type = 'long' AND o.type = 'int') AS back, o.type <> n.type AND NOT (o.type = 'long' AND n.type = 'int') AS fwd
        FROM p JOIN f n ON n.subject = p.subject AND n.version = p.version JOIN f o ON o.subject = p.subject AND o.version = p.writer AND o.field = n.field)
  GROUP BY ALL),
gone AS (SELECT p.subject, p.version, count(DISTINCT o.field) AS k FROM p JOIN f o ON o.subject = p.subject AND o.version = p.writer
  WHERE NOT o.has_default AND NOT EXISTS (SELECT 1 FROM f n WHERE n.subject = p.subject AND n.version = p.version AND n.field = o.field) GROUP BY ALL)
SELECT subject, version, missing_default, removed_required, type_changes, missing_default + removed_required + type_changes = 0 AS compatible FROM (
SELECT v.subject, v.version, {'coalesce(added.k, 0)' if back else 'CAST(0 AS BIGINT)'} AS missing_default,
  {'coalesce(gone.k, 0)' if fwd else 'CAST(0 AS BIGINT)'} AS removed_required, coalesce(typed.k, 0) AS type_changes
FROM v LEFT JOIN added USING (subject, version) LEFT JOIN typed USING (subject, version) LEFT JOIN gone USING (subject, version))
"""


_PREVIOUS = "SELECT subject, version, previous AS writer FROM v WHERE previous IS NOT NULL"
_ALL = "SELECT a.subject, a.version, b.version AS writer FROM v a JOIN v b ON a.subject = b.subject AND b.version < a.version"


def _checked(name: str, mode: str, sql: str) -> None:
    @plan(name, "GOV-5", sql)
    def _(t):
        return G.check_compatibility(field_versions(t), mode, width=100000).drop("symbol_changes")


_checked("compat_backward", "BACKWARD", _compat(_PREVIOUS, True, False))
_checked("compat_backward_transitive", "BACKWARD_TRANSITIVE", _compat(_ALL, True, False))
_checked("compat_forward", "FORWARD", _compat(_PREVIOUS, False, True))
_checked("compat_forward_transitive", "FORWARD_TRANSITIVE", _compat(_ALL, False, True))
_checked("compat_full", "FULL", _compat(_PREVIOUS, True, True))
_checked("compat_full_transitive", "FULL_TRANSITIVE", _compat(_ALL, True, True))


def _by_subject() -> str:
    """SQL of the check with the mode of each subject, by its number."""
    parts = [f"SELECT subject, version, 0 AS missing_default, 0 AS removed_required, 0 AS type_changes, true AS compatible, 'NONE' AS mode FROM (WITH {_FIELDS} SELECT * FROM v) WHERE subject % 7 = 0"]
    for i, mode in enumerate(G.MODES[1:], 1):
        pairs = _ALL if mode.endswith("_TRANSITIVE") else _PREVIOUS
        parts.append(f"SELECT *, '{mode}' AS mode FROM ({_compat(pairs, not mode.startswith('FORWARD'), not mode.startswith('BACKWARD'))}) WHERE subject % 7 = {i}")
    return " UNION ALL ".join(parts)


@plan("compat_by_subject", "GOV-5", _by_subject())
def _(t):
    number = F.col("c_custkey") % 7
    modes = t.customer.filter(number > 0).select(
        F.col("c_custkey").alias("subject"), F.element_at(F.array(*[F.lit(m) for m in G.MODES]), (number + 1).cast("int")).alias("compatibility"))
    return G.check_compatibility_by_subject(field_versions(t), modes, width=100000).drop("symbol_changes")


@plan("effective_settings", "GOV-6", f"""
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 24 END, CASE tier WHEN 'critical' THEN 12 WHEN 'compliance' THEN 12 WHEN 'best-effort' THEN 3 ELSE 6 END) AS partitions,
  CASE tier WHEN 'critical' THEN 604800000 WHEN 'best-effort' THEN 86400000 WHEN 'compliance' THEN 7 * 31557600000 ELSE 259200000 END::BIGINT AS retention_ms,
  CASE tier WHEN 'critical' THEN 'FULL_TRANSITIVE' WHEN 'compliance' THEN 'FULL_TRANSITIVE' WHEN 'standard' THEN 'BACKWARD_TRANSITIVE' ELSE 'BACKWARD' END AS compatibility,
  CASE tier WHEN 'critical' THEN 6 WHEN 'compliance' THEN 6 WHEN 'best-effort' THEN 1 ELSE 3 END AS tasks_sink,
  CASE tier WHEN 'critical' THEN 4 WHEN 'compliance' THEN 4 WHEN 'best-effort' THEN 1 WHEN 'standard' THEN 2 ELSE 3 END AS tasks_source
FROM (SELECT *, {_TIER} AS tier FROM orders)
""")
def _(t):
    rows = t.orders.select("o_orderkey", order_tier().alias("tier"), F.when(F.col("o_orderstatus") == "F", 24).alias("partitions_override"))
    return effective_settings(rows, retention_years=7).drop("tier", "partitions_override")


@plan("check_tiers", "GOV-7", f"""
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN {_TIER} WHEN 'F' THEN 'gold' ELSE coalesce({_TIER}, '') END AS tier,
  CASE WHEN o_custkey % 3 = 0 THEN -1 WHEN o_custkey % 3 = 1 THEN CAST(floor(o_totalprice) AS BIGINT) * 2000 END AS r,
  CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 8 END AS p FROM orders)
SELECT o_orderkey, concat_ws('; ', CASE WHEN tier IS NULL OR tier = '' THEN 'tier is missing' END, CASE WHEN tier = 'gold' THEN 'unknown tier ''gold''' END,
  CASE WHEN r <> -1 AND r < CASE tier WHEN 'critical' THEN 604800000 WHEN 'standard' THEN 259200000 WHEN 'best-effort' THEN 86400000 WHEN 'compliance' THEN 220898482000 END
    THEN 'retention override below tier minimum' END,
  CASE WHEN p < CASE tier WHEN 'critical' THEN 6 WHEN 'standard' THEN 3 WHEN 'best-effort' THEN 1 WHEN 'compliance' THEN 3 END
    THEN 'partitions override below tier minimum' END) AS errors FROM t
""")
def _(t):
    status, cust = F.col("o_orderstatus"), F.col("o_custkey")
    rows = t.orders.select(
        "o_orderkey",
        F.when(status == "P", order_tier()).when(status == "F", "gold").otherwise(F.coalesce(order_tier(), F.lit(""))).alias("tier"),
        F.when(cust % 3 == 0, -1).when(cust % 3 == 1, F.floor("o_totalprice") * 2000).alias("retention_ms_override"),
        F.when(cust % 2 == 0, cust % 8).alias("partitions_override"),
    )
    return G.check_tiers(rows).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


def _classified(t):
    topics = binding_topics(t)
    return topics.join(
        t.customer.select(
            F.concat(F.lit("topic-"), "c_custkey").alias("topic"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "confidential").alias("classification"), "c_nationkey", "c_mktsegment",
        ), "topic",
    )


@plan("check_access", "GOV-8", """
SELECT 'topic-' || c_custkey AS topic, concat_ws('; ', CASE WHEN c_nationkey = 4 THEN 'no producer defined' END,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal > 0 THEN 'confidential topic requires a consumer' END) AS errors FROM customer
""")
def _(t):
    rows = _classified(t).withColumn("producers", F.when(F.col("c_nationkey") != 4, F.col("producers")))
    return G.check_access(rows).select("topic", F.array_join("errors", "; ").alias("errors"))


@plan("unique_principals", "SET-3", """
SELECT DISTINCT principal FROM (SELECT 'User:p' || c_nationkey AS principal FROM customer
  UNION ALL SELECT 'User:c' || c_nationkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'svc' FROM customer WHERE c_acctbal > 0)
""")
def _(t):
    return G.unique_principals(binding_topics(t))


@plan("plan_bindings", "GOV-9", """
WITH b AS (SELECT 'topic-' || c_custkey AS topic, 'User:p' || c_nationkey AS p, CASE WHEN c_acctbal > 0 THEN 'User:c' || c_nationkey END AS c,
  CASE WHEN c_acctbal > 0 THEN 'svc' END AS s, c_nationkey AS n FROM customer),
a AS (SELECT p AS principal, 'DeveloperWrite' AS role, topic FROM b UNION ALL SELECT c, 'DeveloperRead', topic FROM b WHERE c IS NOT NULL
  UNION ALL SELECT s, 'DeveloperRead', topic FROM b WHERE s IS NOT NULL),
d AS (SELECT DISTINCT principal, role, 'Topic' AS resource_type, topic AS name, 'LITERAL' AS pattern_type FROM a
  UNION SELECT principal, role, 'Subject', topic || '-value', 'LITERAL' FROM a UNION SELECT principal, role, 'Subject', topic || '-key', 'LITERAL' FROM a
  UNION SELECT c, 'DeveloperRead', 'Group', 'c' || n || '-', 'PREFIXED' FROM b WHERE c IS NOT NULL),
cur AS (SELECT DISTINCT 'User:p' || (o_custkey % 30) AS principal, 'DeveloperWrite' AS role,
  CASE o_orderstatus WHEN 'F' THEN 'Cluster' ELSE 'Topic' END AS resource_type, 'topic-' || o_custkey AS name, 'LITERAL' AS pattern_type FROM orders),
mine AS (SELECT * FROM cur WHERE resource_type = 'Topic' AND principal IN (SELECT principal FROM d))
SELECT 'add' AS action, * FROM (SELECT * FROM d EXCEPT SELECT * FROM mine) UNION ALL SELECT 'remove', * FROM (SELECT * FROM mine EXCEPT SELECT * FROM d)
""")
def _(t):
    current = t.orders.select(
        F.concat(F.lit("User:p"), F.col("o_custkey") % 30).alias("principal"), F.lit("DeveloperWrite").alias("role"),
        F.when(F.col("o_orderstatus") == "F", "Cluster").otherwise("Topic").alias("resource_type"),
        F.concat(F.lit("topic-"), "o_custkey").alias("name"), F.lit("LITERAL").alias("pattern_type"),
    )
    return G.plan_bindings(binding_topics(t), current)


def settings(t):
    """Desired settings per customer, and current ones as its latest orders left them."""
    desired = t.customer.select(F.col("c_custkey").alias("topic"), F.explode(F.create_map(
        F.lit("retention.ms"), F.lit("86400000"), F.lit("min.insync.replicas"), (F.col("c_nationkey") % 3).cast("string"),
        F.lit("cleanup.policy"), F.lit("delete"))).alias("name", "value"))
    latest = t.orders.groupBy(F.col("o_custkey").alias("topic")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max("o_orderkey").alias("k"))
    current = latest.select("topic", F.explode(F.create_map(
        F.lit("retention.ms"), F.when(F.col("s") == "F", " 86400000 ").otherwise("1"),
        F.lit("min.insync.replicas"), (F.col("k") % 3).cast("string"))).alias("name", "value"))
    return desired, current


_SETTINGS = """
d AS (SELECT c_custkey AS topic, unnest([['retention.ms', '86400000'], ['min.insync.replicas', CAST(c_nationkey % 3 AS VARCHAR)], ['cleanup.policy', 'delete']]) AS kv FROM customer),
l AS (SELECT o_custkey AS topic, arg_max(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS k FROM orders GROUP BY 1),
c AS (SELECT topic, unnest([['retention.ms', CASE s WHEN 'F' THEN ' 86400000 ' ELSE '1' END], ['min.insync.replicas', CAST(k % 3 AS VARCHAR)]]) AS kv FROM l),
x AS (SELECT d.topic, d.kv[1] AS name, d.kv[2] AS value, coalesce(trim(c.kv[2]), '') <> d.kv[2] AS differs
  FROM d LEFT JOIN c ON d.topic = c.topic AND d.kv[1] = c.kv[1])
"""


@plan("plan_config", "GOV-10 JOIN-8", f"WITH {_SETTINGS} SELECT topic, name, value, 'SET' AS operation FROM x WHERE differs")
def _(t):
    return G.plan_config(*settings(t))


@plan("config_outcomes", "GOV-10", f"""
WITH {_SETTINGS} SELECT topic, count(*) FILTER (differs) AS to_set, CASE WHEN bool_or(differs) THEN 'updated' ELSE 'unchanged' END AS outcome FROM x GROUP BY 1
""")
def _(t):
    return G.config_outcomes(*settings(t))


@plan("config_totals", "GOV-10", f"""
WITH {_SETTINGS}, o AS (SELECT topic, bool_or(differs) AS u FROM x GROUP BY 1)
SELECT count(*) FILTER (u) AS updated, count(*) FILTER (NOT u) AS unchanged FROM o
""")
def _(t):
    return G.config_totals(G.config_outcomes(*settings(t)))


@plan("check_pii", "GOV-11 JOIN-7", """
WITH t AS (SELECT c_custkey AS topic, c_mktsegment IN ('BUILDING', 'MACHINERY') AS secret, CASE WHEN c_nationkey = 2 THEN [] ELSE ['O', 'F'] END AS pii FROM customer),
m AS (SELECT topic, count(*) AS k FROM (SELECT topic, unnest(pii) AS field FROM t WHERE secret) d
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = d.topic AND o_orderstatus = d.field) GROUP BY 1)
SELECT topic, concat_ws('; ', CASE WHEN secret AND len(pii) = 0 THEN 'confidential topic must declare PII fields' END,
  CASE WHEN k > 0 THEN 'declared PII field not in schema' END) AS errors, coalesce(k, 0) AS missing_fields FROM t LEFT JOIN m USING (topic)
""")
def _(t):
    topics = t.customer.select(
        F.col("c_custkey").alias("topic"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "confidential").alias("classification"),
        F.when(F.col("c_nationkey") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("O"), F.lit("F"))).alias("pii_fields"),
    )
    fields = t.orders.select(F.col("o_custkey").alias("topic"), F.col("o_orderstatus").alias("field"))
    return G.check_pii(topics, fields).select("topic", F.array_join("errors", "; ").alias("errors"), "missing_fields")


@plan("governance_report", "GOV-13", f"""
WITH {_PARTS}, r AS (SELECT 'naming' AS "check", {_part_errors(True)} = '' AS passed FROM parts
  UNION ALL SELECT 'access', NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal > 0) FROM customer)
SELECT "check", count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*) FILTER (passed), count(*) FILTER (NOT passed) FROM r
""")
def _(t):
    naming = G.check_parts(name_parts(t)).select(F.lit("naming").alias("check"), "passed")
    access = G.check_access(_classified(t)).select(F.lit("access").alias("check"), "passed")
    return G.governance_report(naming.unionByName(access))


@plan("topic_metadata", "GOV-14", """
SELECT c_custkey, c_name AS owner, CASE c_nationkey WHEN 2 THEN 'false' ELSE 'true' END AS pii, CASE c_nationkey WHEN 2 THEN '' ELSE 'name,ssn' END AS pii_fields,
  lower(c_mktsegment) AS domain FROM customer
""")
def _(t):
    rows = t.customer.select(
        "c_custkey", F.col("c_name").alias("owner"), F.lit("standard").alias("tier"), F.lit("internal").alias("classification"),
        F.lower("c_mktsegment").alias("domain"), F.lit("app").alias("application"),
        F.when(F.col("c_nationkey") != 2, F.array(F.lit("name"), F.lit("ssn"))).alias("pii_fields"),
    )
    m = F.col("metadata")
    return G.topic_metadata(rows).select("c_custkey", m["owner"].alias("owner"), m["pii"].alias("pii"), m["pii-fields"].alias("pii_fields"),
                                         m["domain"].alias("domain"))

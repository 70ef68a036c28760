import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import (
    connector_name, dead_letter_topic, effective_settings, map_topic, route_topic, split_target, subject_name, table_name, tier_value,
)
from tidemark.operators import governance as G

NAME_CASES = [
    ("payments.transactions.v1.account-transaction", True), ("Core.transactions.v1.account", False),
    ("core.transactions.1.account", False), ("core.transactions.v1." + "a" * 62, False), ("core.transactions.v1." + "a" * 61, True),
    ("core.transactions.v1", False), ("core.transactions.v1.account.extra", False), ("c.transactions.v1.account", False), ("", False),
]


def test_names(spark):
    out = G.check_names(spark.createDataFrame(NAME_CASES, "topic string, want boolean"))
    assert out.filter("passed <> want").count() == 0
    counted = out.filter("topic = 'core.transactions.v1'").collect()[0]
    assert counted["errors"] == ["expected 4 parts, got 3"]


def test_every_bad_part_is_reported(spark):
    df = spark.createDataFrame([("Core", "", "1", None)], "domain string, application string, version string, entity string")
    row = G.check_parts(df).collect()[0]
    assert row["errors"] == ["domain 'Core' is invalid", "application is missing", "version '1' is invalid", "entity is missing"]
    assert row["topic"] is None and not row["passed"]


def test_derived_names(spark):
    df = spark.createDataFrame([("payments.transactions.v1.",)], "t string")
    row = df.select(
        connector_name(F.lit("docstore"), "source", "t").alias("c"), table_name("t").alias("n"),
        dead_letter_topic("database", F.lit("x")).alias("d"), split_target(F.lit("a.b.c")).alias("s"),
        route_topic(F.lit("db1.banking.member"), r"db1\.banking\.(.+)", "core.$1").alias("r"),
        route_topic(F.lit("x.db1.banking.member"), r"db1\.banking\.(.+)", "core.$1").alias("u"),
        map_topic("t", {}).alias("m"),
        subject_name(F.lit("org.example.bank.core.v1"), F.lit("AccountTransaction")).alias("subject"),
        subject_name(F.lit("short.ns"), F.lit("A")).alias("short"),
    ).collect()[0]
    assert row["c"] == "database-docstore-source-payments-transactions-v1"
    assert (row["n"], row["d"], tuple(row["s"])) == ("payments_transactions_v1_", "database.dlq.x", ("a", "b", "c"))
    assert (row["r"], row["u"], row["m"]) == ("core.member", "x.db1.banking.member", "payments.transactions.v1.")
    assert (row["subject"], row["short"]) == ("bank.core.v1.account-transaction-value", "short.ns.a-value")


def test_settings(spark):
    df = spark.createDataFrame([("critical", None), ("compliance", 5), ("odd", None)], "tier string, partitions_override int")
    rows = {r["tier"]: r for r in effective_settings(df, retention_years=-1).collect()}
    assert (rows["critical"]["partitions"], rows["compliance"]["partitions"], rows["odd"]["partitions"]) == (12, 5, 6)
    assert (rows["critical"]["retention_ms"], rows["compliance"]["retention_ms"], rows["odd"]["retention_ms"]) == (604800000, -1, 259200000)
    assert rows["odd"]["compatibility"] == "BACKWARD"


def test_tier_lookup(spark):
    df = spark.createDataFrame([("critical",), ("compliance",)], "tier string")
    assert [r[0] for r in df.select(tier_value("tier", "ttl_s", strict=True)).collect()] == [None, None]
    assert [r[0] for r in df.select(tier_value("tier", "partitions", strict=True)).collect()] == [12, 12]
    with pytest.raises(Exception, match="unknown tier gold"):
        df.select(tier_value(F.lit("gold"), "compatibility", strict=True)).collect()
    with pytest.raises(ValueError, match="unknown tier setting"):
        tier_value("tier", "colour")


READS = {
    "int": {"int"}, "long": {"int", "long"}, "float": {"int", "long", "float"}, "double": {"int", "long", "float", "double"},
    "string": {"string", "bytes"}, "bytes": {"bytes", "string"}, "record X": {"record X"}, "record Y": {"record Y"},
}


def readable(reader, writer):
    """(missing defaults, type changes, lost symbols) when ``reader`` reads what ``writer`` wrote."""
    missing = {f for f, (_, default, _) in reader.items() if f not in writer and not default}
    changed, symbols = set(), set()
    for f in reader.keys() & writer.keys():
        (rt, _, rs), (wt, _, ws) = reader[f], writer[f]
        if rs is not None and ws is not None:
            symbols |= {(f, s) for s in set(ws) - set(rs)}
        elif (rs is None) != (ws is None) or wt not in READS[rt]:
            changed.add(f)
    return missing, changed, symbols


@pytest.mark.parametrize("mode,width", list(itertools.product(["BACKWARD", "BACKWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE"], [2, 1000])))
def test_compatibility(spark, mode, width):
    rng = random.Random(11)
    subjects = {}
    for s in range(6):
        versions, fields = {}, {}
        for v in sorted(rng.sample(range(1, 20), 6)):
            for f in "abcd":
                if rng.random() < 0.4:
                    fields.pop(f, None)
                elif rng.random() < 0.5:
                    fields[f] = (rng.choice(list(READS)), rng.random() < 0.5, None)
            # Enumerations keep their field, so that symbols are compared version by version.
            fields["e"] = ("enum", True, tuple(sorted(rng.sample("XYZ", rng.randrange(1, 4)))))
            versions[v] = dict(fields)
        subjects[f"s{s}"] = versions
    rows = [(s, v, f, t, d, list(sy) if sy else None) for s, vs in subjects.items() for v, fs in vs.items() for f, (t, d, sy) in fs.items()]
    df = spark.createDataFrame(rows, "subject string, version int, field string, type string, has_default boolean, symbols array<string>")
    got = {(r["subject"], r["version"]): r for r in G.check_compatibility(df, mode, width=width).collect()}
    for s, versions in subjects.items():
        for i, v in enumerate(sorted(versions)):
            earlier = sorted(versions)[:i] if mode.endswith("TRANSITIVE") else sorted(versions)[max(i - 1, 0):i]
            new = versions[v]
            back = [readable(new, versions[u]) for u in earlier]
            forward = [readable(versions[u], new) for u in earlier] if mode.startswith("FULL") else []
            r = got[(s, v)]
            assert r["missing_default"] == len(set().union(*[b[0] for b in back]))
            assert r["removed_required"] == len(set().union(*[b[0] for b in forward]))
            assert r["type_changes"] == max(len(set().union(*[b[1] for b in back])), len(set().union(*[b[1] for b in forward])))
            broken = any(any(x) for x in back + forward)
            assert r["compatible"] == (not broken)


def test_incompatible_without_default(spark):
    """A new required field breaks readers of old records; the first version always passes."""
    rows = [("t", 1, "test_key", "string", False), ("t", 1, "test_value", "string", False), ("t", 1, "timestamp", "long", False),
            ("t", 2, "test_key", "string", False), ("t", 2, "breaking_new_field", "string", False)]
    out = G.check_compatibility(spark.createDataFrame(rows, "subject string, version int, field string, type string, has_default boolean"), "BACKWARD")
    assert {r["version"]: r["compatible"] for r in out.collect()} == {1: True, 2: False}


def test_id_stability(spark):
    base, head = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["a", "b"], ["b", "c"]))
    minor = {r["id"]: (r["change"], r["allowed"]) for r in G.check_id_stability(base, head, "1.0.0", "1.9.0").collect()}
    assert minor == {"a": ("removed", False), "c": ("added", True)}
    assert all(r["allowed"] for r in G.check_id_stability(base, head, "1.0.0", "2.0.0").collect())
    assert not all(r["allowed"] for r in G.check_id_stability(base, head, "x", "2.0.0").collect())


def test_access_and_pii(spark):
    topics = spark.createDataFrame(
        [("a", ["User:p"], [], "confidential", ["ssn", "name"]), ("b", [], ["User:c"], None, None), ("c", ["User:p"], ["User:c"], "confidential", [])],
        "topic string, producers array<string>, consumers array<string>, classification string, pii_fields array<string>")
    access = {r["topic"]: r["errors"] for r in G.check_access(topics).collect()}
    assert access == {"a": ["confidential topic requires a consumer"], "b": ["no producer defined"], "c": []}
    pii = {r["topic"]: r["errors"] for r in G.check_pii(topics, spark.createDataFrame([("a", "name")], "topic string, field string")).collect()}
    assert pii == {"a": ["declared PII field not in schema"], "b": [], "c": ["confidential topic must declare PII fields"]}


def test_binding_plan_leaves_others_alone(spark):
    topics = spark.createDataFrame([("t", ["User:p"], ["User:c"])], "topic string, producers array<string>, consumers array<string>")
    current = spark.createDataFrame(
        [("User:p", "DeveloperWrite", "Topic", "t", "LITERAL"), ("User:p", "DeveloperWrite", "Topic", "old", "LITERAL"),
         ("User:p", "DeveloperWrite", "Cluster", "x", "LITERAL"), ("User:other", "DeveloperRead", "Topic", "t", "LITERAL")],
        "principal string, role string, resource_type string, name string, pattern_type string")
    plan = [tuple(r) for r in G.plan_bindings(topics, current).collect()]
    assert [p for p in plan if p[0] == "remove"] == [("remove", "User:p", "DeveloperWrite", "Topic", "old", "LITERAL")]
    adds = {p[1:] for p in plan if p[0] == "add"}
    assert ("User:c", "DeveloperRead", "Group", "c-", "PREFIXED") in adds and len(adds) == 6


def test_metadata_and_report(spark):
    topic = spark.createDataFrame([("o", "d", "a", "standard", "internal", ["x", "y"])], "owner string, domain string, application string, tier string, classification string, pii_fields array<string>")
    tags = G.topic_metadata(topic).collect()[0]["metadata"]
    assert (tags["pii"], tags["pii-fields"], tags["sla-tier"]) == ("true", "x,y", "standard")
    results = spark.createDataFrame([("n", True), ("n", False), ("m", True)], "check string, passed boolean")
    assert {tuple(r) for r in G.governance_report(results).collect()} == {("n", 1, 1), ("m", 1, 0), ("TOTAL", 2, 1)}


def test_a_mode_for_each_subject(spark):
    """The same counts as one check for each mode; subjects without a mode pass."""
    rng, rows = random.Random(12), []
    modes = {"s0": "BACKWARD_TRANSITIVE", "s1": "FORWARD", "s2": "FULL", "s3": None}
    for s in modes:
        for v in range(1, 7):
            for f in rng.sample("abcd", rng.randrange(1, 5)):
                symbols = rng.sample("XYZ", 2) if f == "d" else None
                rows.append((s, v, f, "E" if symbols else rng.choice(["int", "long", "string"]), rng.random() < 0.5, symbols))
    df = spark.createDataFrame(rows, "subject string, version int, field string, type string, has_default boolean, symbols array<string>")
    chosen = spark.createDataFrame([(s, m) for s, m in modes.items() if m], "subject string, compatibility string")
    got = {(r["subject"], r["version"]): r.asDict() for r in G.check_compatibility_by_subject(df, chosen, width=3).collect()}
    assert {r["mode"] for r in got.values()} == {"BACKWARD_TRANSITIVE", "FORWARD", "FULL", "NONE"}
    want = [r.asDict() | {"mode": m or "NONE"} for s, m in modes.items() for r in G.check_compatibility(df.filter(df.subject == s), m or "NONE", width=3).collect()]
    assert len(want) == len(got) and all(got[r["subject"], r["version"]] == r for r in want)
    assert {r["compatible"] for r in got.values()} == {True, False}
    with pytest.raises(Exception, match="unsupported mode"):
        G.check_compatibility_by_subject(df, spark.createDataFrame([("s0", "SIDEWAYS")], "subject string, compatibility string")).collect()


def test_bindings_are_dealt_out_before_they_unfold(spark):
    """Bindings without repeats, also for a topic without a name, and no aggregation in the tasks that read the topics."""
    topics = spark.createDataFrame(
        [("t", ["User:p", "User:p"], ["User:c", "svc"]), ("t", ["User:p"], None), (None, ["User:p"], ["User:c"]), ("u", None, ["User:c"])],
        "topic string, producers array<string>, consumers array<string>")
    got = [tuple(r) for r in G.desired_bindings(topics).collect()]
    want = {("User:c", "DeveloperRead", "Group", "c-", "PREFIXED")}
    for t, p, c in (("t", ["User:p"], ["User:c", "svc"]), (None, ["User:p"], ["User:c"]), ("u", [], ["User:c"])):
        for who, role in [(x, "DeveloperWrite") for x in p] + [(x, "DeveloperRead") for x in c]:
            want |= {(who, role, kind, t and t + end, "LITERAL") for kind, end in (("Topic", ""), ("Subject", "-value"), ("Subject", "-key"))}
    assert len(got) == len(set(got)) and set(got) == want
    text = G.desired_bindings(topics)._jdf.queryExecution().executedPlan().toString()
    grants = text[:text.index("Exchange hashpartitioning(_t")]
    assert "HashAggregate" in grants and "Generate inline(_g" in grants  # above the exchange, so after it


def test_binding_plan_counts_after_the_exchange(spark):
    topics = spark.createDataFrame([("t", ["User:p"], ["User:c"])], "topic string, producers array<string>, consumers array<string>")
    current = spark.createDataFrame([("User:p", "DeveloperWrite", "Topic", "t", "LITERAL")] * 3, "principal string, role string, resource_type string, name string, pattern_type string")
    out = G.plan_bindings(topics, current)
    assert out.count() == 6 and {r["action"] for r in out.collect()} == {"add"}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text[:text.index("Exchange hashpartitioning(principal")].count("HashAggregate") == 2

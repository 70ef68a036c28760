"""Governance checks as table jobs: one row per topic, schema version, binding or setting."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.slices import scan
from tidemark.functions.tiers import known_tier, tier_value
from tidemark.operators.changes import id_diff
from tidemark.session import dealt, durable

# The naming patterns of the four name parts, in order.
NAME_PATTERNS = {
    "domain": "^[a-z][a-z0-9-]{1,30}$",
    "application": "^[a-z][a-z0-9-]{1,30}$",
    "version": "^v[0-9]+$",
    "entity": "^[a-z][a-z0-9-]{1,60}$",
}


def _errors(*checks: tuple[Column, Column | str]) -> Column:
    """Messages of the checks whose condition holds, in order."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), message if isinstance(message, Column) else F.lit(message))
        for bad, message in checks
    ]))


def _with_verdict(df: DataFrame, errors: Column) -> DataFrame:
    return df.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


def check_parts(df: DataFrame, parts: Mapping[str, str] | None = None) -> DataFrame:
    """Validate the four name parts; ``topic`` is assembled when all are valid."""
    parts = dict(parts or {p: p for p in NAME_PATTERNS})
    checks = []
    for label, pattern in NAME_PATTERNS.items():
        value = F.col(parts[label])
        absent = value.isNull() | (value == "")
        checks.append((absent, f"{label} is missing"))
        checks.append((~absent & ~value.rlike(pattern), F.concat(F.lit(f"{label} '"), value, F.lit("' is invalid"))))
    out = _with_verdict(df, _errors(*checks))
    return out.withColumn("topic", F.when(F.col("passed"), F.concat_ws(".", *[F.col(parts[p]) for p in NAME_PATTERNS])))


def check_names(df: DataFrame, name: str = "topic") -> DataFrame:
    """Validate whole topic names: the number of parts, then every part."""
    pieces = F.split(F.col(name), "\\.")
    four = F.size(pieces) == 4
    checks = [(~four, F.concat(F.lit("expected 4 parts, got "), F.size(pieces).cast("string")))]
    for i, (label, pattern) in enumerate(NAME_PATTERNS.items()):
        value = F.when(four, F.get(pieces, F.lit(i)))
        checks.append((~value.rlike(pattern), F.concat(F.lit(f"{label} '"), value, F.lit("' is invalid"))))
    return _with_verdict(df, _errors(*checks))


def schema_fields(schemas: DataFrame, document: str = "document") -> DataFrame:
    """One row per field of each schema document: name, type text, whether it has a default, symbols, doc."""
    items = F.from_json(F.get_json_object(document, "$.fields"), "array<string>")
    rows = schemas.withColumn("_f", F.explode(items)).withColumn("_m", F.from_json("_f", "map<string,string>"))
    kind = F.get_json_object("_f", "$.type")
    return rows.select(
        *[c for c in schemas.columns if c != document],
        F.col("_m")["name"].alias("field"),
        kind.alias("type"),
        F.map_contains_key("_m", "default").alias("has_default"),
        F.from_json(F.get_json_object(kind, "$.symbols"), "array<string>").alias("symbols"),
        F.col("_m")["doc"].alias("doc"),
    )


def check_schemas(schemas: DataFrame, organisation: str, document: str = "document") -> DataFrame:
    """Structure and namespace checks. ``organisation`` is the namespace root, such as ``org.example``."""
    pattern = "^" + organisation.replace(".", r"\.") + r"\.[a-z][a-z0-9-]*\.[a-z][a-z0-9-]*\.v[0-9]+$"
    doc = F.col(document)
    # The one-element explode reads each document once instead of once per check.
    parsed = schemas.withColumn("_d", F.explode(F.array(F.struct(
        F.get_json_object(doc, "$.type").alias("kind"), F.get_json_object(doc, "$.namespace").alias("ns"),
        F.get_json_object(doc, "$.name").alias("name"), F.try_parse_json(doc).isNull().alias("broken"),
        F.from_json(F.get_json_object(doc, "$.fields"), "array<map<string,string>>").alias("items"),
    ))))
    kind, ns, name, broken, items = (F.col(f"_d.{c}") for c in ("kind", "ns", "name", "broken", "items"))
    blank = F.coalesce(ns, F.lit("")) == ""
    untyped = F.filter(items, lambda f: ~F.map_contains_key(f, "type"))
    unnamed = F.filter(items, lambda f: ~F.map_contains_key(f, "name"))
    errors = _errors(
        (broken, "invalid JSON"),
        (~broken & ~kind.eqNullSafe(F.lit("record")), "type must be record"),
        (~broken & blank, "missing namespace"),
        (~broken & (F.coalesce(name, F.lit("")) == ""), "missing name"),
        (~broken & (F.coalesce(F.size(items), F.lit(0)) <= 0), "missing or empty fields"),
        (F.size(unnamed) > 0, "field without name"),
        (F.size(untyped) > 0, "field without type"),
        (~broken & ~blank & ~ns.rlike(pattern), "namespace does not match"),
    )
    return _with_verdict(parsed, errors).drop("_d")


# Primitive types and, for each, the written types its reader accepts.
PRIMITIVES = ("int", "long", "float", "double", "string", "bytes", "boolean", "null")
PROMOTIONS = {
    "int": ("int",),
    "long": ("int", "long"),
    "float": ("int", "long", "float"),
    "double": ("int", "long", "float", "double"),
    "string": ("string", "bytes"),
    "bytes": ("bytes", "string"),
    "boolean": ("boolean",),
    "null": ("null",),
}
_OTHER = 1 << len(PRIMITIVES)


def _type_bit(kind: Column) -> Column:
    out = F.lit(_OTHER)
    for i, p in enumerate(PRIMITIVES):
        out = F.when(kind == p, F.lit(1 << i)).otherwise(out)
    return out


def _accepted_bits(kind: Column) -> Column:
    out = F.lit(_OTHER)
    for reader, writers in PROMOTIONS.items():
        out = F.when(kind == reader, F.lit(sum(1 << PRIMITIVES.index(w) for w in writers))).otherwise(out)
    return out


# Rows (version, field) and symbols of a subject that one task takes; a larger subject is cut into ranges of versions.
WHOLE = 100_000


def _by_size(fields: DataFrame, subject: str, whole: int, width: int, check: Callable[[DataFrame, int | None], DataFrame]) -> DataFrame:
    """A check given the subjects of at most ``whole`` rows with no width, and the larger ones, if any, with theirs."""
    weight = F.greatest(F.coalesce(F.size("symbols"), F.lit(0)), F.lit(0)) + 1 if "symbols" in fields.columns else F.lit(1)
    sizes = durable(fields.groupBy(subject).agg(F.sum(weight).alias("_rows")), "sizes")
    rows, of_large = sizes.agg(F.sum("_rows"), F.sum(F.when(F.col("_rows") > whole, F.col("_rows")))).first()
    if not of_large:
        return check(dealt(fields, rows or 0, subject), None)
    large = sizes.filter(F.col("_rows") > whole).select(subject)
    light = check(dealt(fields.join(large, subject, "left_anti"), rows - of_large, subject), None)
    return light.unionByName(check(fields.join(large, subject, "left_semi"), width))


def _numbered(rows: DataFrame, group: list[str], width: int | None) -> DataFrame:
    """Rows with the version before theirs and the rank of their version within the group."""
    if width is None:
        along = Window.partitionBy(*group).orderBy("version")
        return rows.dropna(subset=[*group, "version"]).withColumns({
            "previous": F.max("version").over(along.rangeBetween(Window.unboundedPreceding, -1)), "rank": F.dense_rank().over(along).cast("long"),
        })
    distinct = rows.select(*group, "version").distinct().withColumn("_one", F.lit(1).cast("long"))
    versions = scan(
        durable(distinct, "versions"), group, "version", width=width,
        previous={"previous": "version"}, running={"rank": ("sum", "_one")},
    )
    return durable(rows.join(versions.drop("_one"), [*group, "version"]), "numbered")


_SEEN = {"previous": {"_seen_at": "version", "_req_before": "_req"},
         "before": {"_seen_n": ("sum", "_one"), "_first_req": ("min", "_mark")}}


def _markable(rows: DataFrame, required: Column) -> DataFrame:
    return rows.withColumn("_req", required).withColumns(
        {"_one": F.lit(1).cast("long"), "_mark": F.when(F.col("_req"), F.col("version"))}
    )


def _presence(scanned: DataFrame, group: list[str], width: int | None, others: list[Column]) -> DataFrame:
    """Per (group, version): required items new to it and required items gone from it, against the
    previous and against all earlier versions, and the given other aggregates.

    Counts come from running values per item; no pairs of versions are formed.
    """
    was_in_previous = F.col("_seen_at").eqNullSafe(F.col("previous"))
    later = F.col("previous").isNotNull()
    here = scanned.groupBy(*group, "version").agg(
        F.count_if(F.col("_req")).alias("_required"),
        F.count_if(F.col("_req") & later & ~was_in_previous).alias("new_vs_previous"),
        F.count_if(F.col("_req") & (F.coalesce("_seen_n", F.lit(0)) < F.col("rank") - 1)).alias("new_vs_all"),
        F.count_if(was_in_previous & F.col("_req_before")).alias("_kept"),
        F.count_if(F.col("_first_req").isNotNull()).alias("_kept_ever"),
        F.count_if(F.col("_req") & F.col("_first_req").isNull()).alias("_first_seen"),
        *others,
    )
    here = here if width is None else durable(here, "presence")
    out = scan(here, group, "version", width=width, previous={"_had": "_required"}, before={"_ever": ("sum", "_first_seen")})
    return out.withColumns({
        "gone_vs_previous": F.coalesce("_had", F.lit(0)) - F.col("_kept"),
        "gone_vs_all": F.coalesce("_ever", F.lit(0)) - F.col("_kept_ever"),
    })


MODES = ("NONE", *(m + t for m in ("BACKWARD", "FORWARD", "FULL") for t in ("", "_TRANSITIVE")))


def check_compatibility_by_subject(
    fields: DataFrame, modes: DataFrame, subject: str = "subject", width: int = 1000, whole: int = WHOLE,
) -> DataFrame:
    """The same with a ``mode`` for each subject, from ``modes`` (subject, ``compatibility``), one row a subject; those without one pass as NONE.

    Counts against the previous and against all earlier versions come from one scan, whatever the modes. An unknown mode fails the job.
    """
    return _by_size(fields, subject, whole, width, lambda part, cut: _checked_by_subject(part, modes, subject, cut))


def _checked_by_subject(fields: DataFrame, modes: DataFrame, subject: str, width: int | None) -> DataFrame:
    rows = _markable(_typed(_numbered(fields, [subject], width)), ~F.col("has_default"))
    carried = {"_written": ("bit_or", "_bit"), "_readers": ("bit_and", "_accepts"), "_low": ("min", "_other"), "_high": ("max", "_other")}
    scanned = scan(
        rows, [subject, "field"], "version", width=width,
        previous=_SEEN["previous"] | {f"{n}_previous": column for n, (_, column) in carried.items()},
        before=_SEEN["before"] | {f"{n}_all": how for n, how in carried.items()},
    )
    others = []
    for against, comparable in (("previous", F.col("_seen_at").eqNullSafe(F.col("previous"))), ("all", F.lit(True))):
        renamed, unread, unreadable = _type_faults(f"_{against}")
        for side, broken in (("back", renamed | unread), ("fwd", renamed | unreadable), ("both", renamed | unread | unreadable)):
            others.append(F.count_if(comparable & F.coalesce(broken, F.lit(False))).alias(f"types_{side}_{against}"))
    out = _presence(scanned, [subject], width, others)
    mode = F.col("mode")
    against = lambda name: F.when(mode.endswith("_TRANSITIVE"), F.col(f"{name}_all")).otherwise(F.col(f"{name}_previous"))
    backward, forward = mode.startswith("BACKWARD") | mode.startswith("FULL"), mode.startswith("FORWARD") | mode.startswith("FULL")
    counts = {
        "missing_default": F.when(backward, against("new_vs")),
        "removed_required": F.when(forward, against("gone_vs")),
        "type_changes": F.when(backward & forward, against("types_both")).when(backward, against("types_back")).when(forward, against("types_fwd")),
        "symbol_changes": F.lit(0),
    }
    if "symbols" in fields.columns:
        group = [subject, "field"]
        symbols = fields.select(*group, "version", F.explode("symbols").alias("symbol")).distinct()
        symbols = _markable(_numbered(symbols, group, width), F.lit(True))
        seen = _presence(scan(symbols, [*group, "symbol"], "version", width=width, **_SEEN), group, width, [])
        sums = [F.sum(f"{n}_vs_{a}").alias(f"symbols_{n}_{a}") for n in ("gone", "new") for a in ("previous", "all")]
        out = out.join(seen.groupBy(subject, "version").agg(*sums), [subject, "version"], "left")
        counts["symbol_changes"] = F.coalesce(F.when(backward, against("symbols_gone")), F.lit(0)) + F.coalesce(F.when(forward, against("symbols_new")), F.lit(0))
    chosen = F.coalesce(F.col("compatibility"), F.lit("NONE"))
    known = F.when(chosen.isin(*MODES), chosen).otherwise(F.raise_error(F.concat(F.lit("unsupported mode "), chosen)).cast("string"))
    out = out.join(modes.select(subject, "compatibility"), subject, "left").withColumn("mode", known)
    out = out.select(subject, "version", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()], "mode")
    total = sum((F.col(n) for n in counts), F.lit(0))
    return out.select(subject, "version", *counts, (total == 0).alias("compatible"), "mode")


def _typed(fields: DataFrame) -> DataFrame:
    """Fields with their type as a bit, the types its reader accepts as bits, and the text of a type without a bit of its own."""
    text = F.when(F.col("symbols").isNotNull(), F.lit("enum")).otherwise(F.col("type")) if "symbols" in fields.columns else F.col("type")
    base = fields.withColumn("_type", text)
    base = base.withColumns({"_bit": _type_bit(F.col("_type")), "_accepts": _accepted_bits(F.col("_type"))})
    return base.withColumn("_other", F.when(F.col("_bit") == _OTHER, F.col("_type")))


def _type_faults(suffix: str = "") -> tuple[Column, Column, Column]:
    """Whether a type without a bit changed, an earlier type is not read here, and this type is not read there."""
    written, readers, low, high = (F.col(f"{n}{suffix}") for n in ("_written", "_readers", "_low", "_high"))
    renamed = (F.col("_bit") == _OTHER) & ((low != F.col("_type")) | (high != F.col("_type")))
    return renamed, written.bitwiseAND(F.bitwise_not("_accepts")) != 0, readers.bitwiseAND(F.col("_bit")) == 0


def check_compatibility(fields: DataFrame, mode: str, subject: str = "subject", width: int = 1000, whole: int = WHOLE) -> DataFrame:
    """Compatibility of every schema version with the one before it, or with all before it.

    ``fields`` has one row per (subject, version, field) with ``type``, ``has_default`` and optionally
    ``symbols``. Modes: BACKWARD (the new version reads the old ones), FORWARD (the old ones read the new) and FULL
    (both), each also ``_TRANSITIVE``, and NONE, which passes everything. Rules: a reader field that the
    writer lacks needs a default; types may only change by numeric or string/bytes promotion; a reader's
    enumeration holds every written symbol. ``type_changes`` counts fields, each once. The first version of a subject always passes. Other Avro
    rules (aliases, unions, nested records) are not checked: such types must be equal.

    Versions are ordered integers. A subject of at most ``whole`` rows goes to one task, all its steps in one shuffle. Of a
    larger one, ``width`` is the range of versions that one task takes; its intermediate tables go to the shared folder.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode {mode!r}")
    if mode == "NONE":
        none = [F.lit(0).cast("long").alias(n) for n in ("missing_default", "removed_required", "type_changes", "symbol_changes")]
        return fields.select(subject, "version").distinct().select("*", *none, F.lit(True).alias("compatible"))
    return _by_size(fields, subject, whole, width, lambda part, cut: _checked(part, mode, subject, cut))


def _checked(fields: DataFrame, mode: str, subject: str, width: int | None) -> DataFrame:
    against = "all" if mode.endswith("_TRANSITIVE") else "previous"
    backward, forward = not mode.startswith("FORWARD"), not mode.startswith("BACKWARD")
    enums = "symbols" in fields.columns
    rows = _markable(_typed(_numbered(fields, [subject], width)), ~F.col("has_default"))
    if against == "all":
        typed = {"before": {"_written": ("bit_or", "_bit"), "_readers": ("bit_and", "_accepts"),
                            "_low": ("min", "_other"), "_high": ("max", "_other")}}
        comparable = F.lit(True)
    else:
        typed = {"previous": {"_written": "_bit", "_readers": "_accepts", "_low": "_other", "_high": "_other"}}
        comparable = F.col("_seen_at").eqNullSafe(F.col("previous"))
    scanned = scan(
        rows, [subject, "field"], "version", width=width, previous={**_SEEN["previous"], **typed.get("previous", {})},
        before={**_SEEN["before"], **typed.get("before", {})},
    )
    renamed, unread, unreadable = _type_faults()
    broken = renamed
    if backward:
        broken = broken | unread
    if forward:
        broken = broken | unreadable
    out = _presence(scanned, [subject], width, [F.count_if(comparable & F.coalesce(broken, F.lit(False))).alias("type_broken")])
    symbol_back = symbol_fwd = F.lit(0)
    if enums:
        group = [subject, "field"]
        symbols = fields.select(*group, "version", F.explode("symbols").alias("symbol")).distinct()
        symbols = _markable(_numbered(symbols, group, width), F.lit(True))
        seen = _presence(scan(symbols, [*group, "symbol"], "version", width=width, **_SEEN), group, width, [])
        seen = seen.groupBy(subject, "version").agg(
            F.sum(f"gone_vs_{against}").alias("symbols_gone"), F.sum(f"new_vs_{against}").alias("symbols_new")
        )
        out = out.join(seen, [subject, "version"], "left")
        symbol_back, symbol_fwd = F.coalesce("symbols_gone", F.lit(0)), F.coalesce("symbols_new", F.lit(0))
    counts = {
        "missing_default": F.col(f"new_vs_{against}") if backward else F.lit(0),
        "removed_required": F.col(f"gone_vs_{against}") if forward else F.lit(0),
        "type_changes": F.col("type_broken"),
        "symbol_changes": (symbol_back if backward else F.lit(0)) + (symbol_fwd if forward else F.lit(0)),
    }
    out = out.select(subject, "version", *[c.cast("long").alias(n) for n, c in counts.items()])
    total = sum((F.col(n) for n in counts), F.lit(0))
    return out.withColumn("compatible", total == 0)


def check_tiers(df: DataFrame, tier: str = "tier") -> DataFrame:
    """Overrides may not go below the tier's minimum; -1 retention is unlimited; the tier must be known."""
    t = F.col(tier)
    absent = t.isNull() | (t == "")
    known = known_tier(t)
    low_retention = (F.col("retention_ms_override") != -1) & (F.col("retention_ms_override") < tier_value(t, "min_retention_ms"))
    low_partitions = F.col("partitions_override") < tier_value(t, "min_partitions")
    return _with_verdict(df, _errors(
        (absent, "tier is missing"),
        (~absent & ~known, F.concat(F.lit("unknown tier '"), t, F.lit("'"))),
        (known & low_retention, "retention override below tier minimum"),
        (known & low_partitions, "partitions override below tier minimum"),
    ))


def check_access(df: DataFrame, producers="producers", consumers="consumers", classification="classification"):
    """At least one producer; a confidential topic also needs a consumer."""
    none_write = F.coalesce(F.size(producers), F.lit(0)) <= 0
    none_read = F.coalesce(F.size(consumers), F.lit(0)) <= 0
    secret = F.coalesce(F.col(classification), F.lit("internal")) == "confidential"
    return _with_verdict(df, _errors(
        (none_write, "no producer defined"), (secret & none_read, "confidential topic requires a consumer"),
    ))


def unique_principals(df: DataFrame, producers: str = "producers", consumers: str = "consumers") -> DataFrame:
    """Distinct principals over both lists of all topics."""
    empty = F.array().cast("array<string>")
    every = F.concat(F.coalesce(producers, empty), F.coalesce(consumers, empty))
    return df.select(F.explode(F.array_distinct(every)).alias("principal")).distinct()


_BINDING = ("principal", "role", "resource_type", "name", "pattern_type")


def desired_bindings(df: DataFrame, topic="topic", producers="producers", consumers="consumers") -> DataFrame:
    """Bindings each topic needs: topic, subjects (value and key), and group prefixes of its consumers.

    Topics are dealt out by name before their lists are unfolded, and a grant is made single before it becomes three
    bindings, so no task holds more than its share of them whatever the files of the input are.
    """
    def grants(column: str, role: str) -> Column:
        none = F.array().cast("array<struct<principal:string,role:string>>")
        return F.coalesce(F.transform(column, lambda p: F.struct(p.alias("principal"), F.lit(role).alias("role"))), none)

    def binding(*parts: Column | str) -> Column:
        return F.struct(*[(F.lit(c) if isinstance(c, str) else c).alias(n) for c, n in zip(parts, _BINDING)])

    dealt = df.select(F.col(topic).alias("_t"), F.concat(grants(producers, "DeveloperWrite"), grants(consumers, "DeveloperRead")).alias("_g"))
    granted = dealt.repartition("_t").select("_t", F.inline("_g")).distinct()
    t, p, role = F.col("_t"), F.col("principal"), F.col("role")
    # Without a topic both subjects have the same name, null.
    key = F.when(t.isNotNull(), binding(p, role, "Subject", F.concat(t, F.lit("-key")), "LITERAL"))
    three = F.array(binding(p, role, "Topic", t, "LITERAL"), binding(p, role, "Subject", F.concat(t, F.lit("-value")), "LITERAL"), key)
    on_topics = granted.select(F.inline(F.array_compact(three)))
    users = df.select(F.explode(F.array_distinct(F.filter(consumers, lambda c: c.startswith("User:")))).alias("_u")).distinct()
    prefix = F.concat(F.substring("_u", 6, 1 << 30), F.lit("-"))
    return on_topics.unionByName(users.select(F.inline(F.array(binding(F.col("_u"), "DeveloperRead", "Group", prefix, "PREFIXED")))))


def plan_bindings(topics: DataFrame, current: DataFrame, **columns) -> DataFrame:
    """``add`` and ``remove`` actions that turn the current bindings into the desired ones.

    Only read and write bindings on topics, groups and subjects of principals the topics name are
    considered; others are left alone.
    """
    wanted = desired_bindings(topics, **columns)
    principals = unique_principals(topics, **{k: v for k, v in columns.items() if k != "topic"})
    mine = current.filter(
        F.col("resource_type").isin("Topic", "Group", "Subject") & F.col("role").isin("DeveloperRead", "DeveloperWrite")
    ).join(principals, "principal", "left_semi")
    both = wanted.select(*_BINDING, F.lit(1).alias("_w"), F.lit(0).alias("_c")).unionByName(
        mine.select(*_BINDING, F.lit(0).alias("_w"), F.lit(1).alias("_c"))
    )
    # Nearly all are single, so they are dealt out as they are and not counted in the tasks that read them.
    merged = both.repartition(*_BINDING).groupBy(*_BINDING).agg(F.max("_w").alias("_w"), F.max("_c").alias("_c"))
    action = F.when(F.col("_w") > F.col("_c"), "add").otherwise("remove")
    return merged.filter(F.col("_w") != F.col("_c")).select(action.alias("action"), *_BINDING)


def _compared(desired: DataFrame, current: DataFrame, topic: str) -> DataFrame:
    now = current.select(topic, "name", F.trim("value").alias("_now"))
    joined = desired.join(now, [topic, "name"], "left")
    return joined.withColumn("_differs", F.coalesce(F.col("_now"), F.lit("")) != F.col("value"))


def plan_config(desired: DataFrame, current: DataFrame, topic: str = "topic") -> DataFrame:
    """Settings to SET: desired values that the current value, trimmed, does not equal.

    Both inputs have one row per (topic, name); an absent current value differs from any desired one.
    """
    return _compared(desired, current, topic).filter("_differs").select(
        topic, "name", "value", F.lit("SET").alias("operation")
    )


def config_outcomes(desired: DataFrame, current: DataFrame, topic: str = "topic") -> DataFrame:
    """Per topic the number of settings to change and whether it is ``updated`` or ``unchanged``."""
    out = _compared(desired, current, topic).groupBy(topic).agg(F.count_if(F.col("_differs")).alias("to_set"))
    return out.withColumn("outcome", F.when(F.col("to_set") > 0, "updated").otherwise("unchanged"))


def config_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
    )


def check_pii(topics: DataFrame, fields: DataFrame, topic: str = "topic", declared: str = "pii_fields") -> DataFrame:
    """A confidential topic must declare PII fields, and each must exist in its schema.

    ``fields`` lists (topic, field). Declared and listed fields meet in one aggregation by (topic, field).
    """
    secret = F.coalesce(F.col("classification"), F.lit("internal")) == "confidential"
    wanted = topics.filter(secret).select(topic, F.explode(declared).alias("field"), F.lit(1).alias("_w"), F.lit(0).alias("_h"))
    have = fields.select(topic, "field", F.lit(0).alias("_w"), F.lit(1).alias("_h"))
    absent = (
        wanted.unionByName(have).groupBy(topic, "field").agg(F.max("_w").alias("_w"), F.max("_h").alias("_h"))
        .filter((F.col("_w") == 1) & (F.col("_h") == 0))
        .groupBy(topic).agg(F.count("*").alias("missing_fields"))
    )
    out = topics.join(absent, topic, "left").withColumn("missing_fields", F.coalesce("missing_fields", F.lit(0)))
    none = F.coalesce(F.size(declared), F.lit(0)) <= 0
    return _with_verdict(out, _errors(
        (secret & none, "confidential topic must declare PII fields"),
        (F.col("missing_fields") > 0, "declared PII field not in schema"),
    ))


def check_id_stability(base: DataFrame, head: DataFrame, base_version: str, head_version: str, key: str = "id"):
    """Removed and added IDs; a removal is ``allowed`` only when the major version rose."""
    def major(version: str) -> int | None:
        first = version.split(".")[0]
        return int(first) if first.isdigit() else None

    old, new = major(base_version), major(head_version)
    rose = old is not None and new is not None and new > old
    allowed = (F.col("change") == "added") | F.lit(rose)
    return id_diff(base, head, key).withColumn("allowed", allowed)


def governance_report(results: DataFrame, check: str = "check", passed: str = "passed") -> DataFrame:
    """Passed and failed counts per check, and a total row."""
    counts = results.rollup(check).agg(
        F.count_if(F.col(passed)).alias("passed"), F.count_if(~F.col(passed)).alias("failed"), F.grouping(check).alias("_all")
    )
    name = F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col(check))
    return counts.select(name.alias(check), "passed", "failed")


def topic_metadata(df: DataFrame, declared: str = "pii_fields", tier: str = "tier") -> DataFrame:
    """Metadata tags of each topic as a map."""
    listed = F.coalesce(F.col(declared), F.array().cast("array<string>"))
    tags = {
        "owner": F.col("owner"), "sla-tier": F.col(tier), "data-classification": F.col("classification"),
        "domain": F.col("domain"), "application": F.col("application"),
        "pii": F.when(F.size(listed) > 0, "true").otherwise("false"), "pii-fields": F.array_join(listed, ","),
    }
    return df.withColumn("metadata", F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]))

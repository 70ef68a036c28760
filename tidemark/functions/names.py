"""Topic, table, connector and subject names as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def route_topic(topic: Column | str, regex: str, replacement: str) -> Column:
    """Rename topics that match the whole regex; other names pass unchanged."""
    return F.regexp_replace(_col(topic), f"^(?:{regex})$", replacement)


def map_topic(topic: Column | str, mapping: Mapping[str, str]) -> Column:
    """Table for a topic from an explicit map; unmapped topics keep their name."""
    t = _col(topic)
    if not mapping:
        return t
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, t), t)


def table_name(topic: Column | str) -> Column:
    return F.translate(_col(topic), ".", "_")


def connector_name(kind: Column | str, direction: str, topic: Column | str) -> Column:
    """``database-<kind>-<direction>-<topic>`` with dots as dashes and outer dashes trimmed."""
    raw = F.concat_ws("-", F.lit("database"), _col(kind), F.lit(direction), F.translate(_col(topic), ".", "-"))
    return F.btrim(raw, F.lit("-"))


def lakehouse_connector_name(kind: Column | str, topic: Column | str) -> Column:
    return F.concat(F.lit("lakehouse-"), F.lower(_col(kind)), F.lit("-"), _col(topic))


def dead_letter_topic(family: str, connector: Column | str) -> Column:
    """``lakehouse.dlq.<sink>`` or ``database.dlq.<connector>``."""
    return F.concat(F.lit(f"{family}.dlq."), _col(connector))


def split_target(target: Column | str) -> Column:
    """Three-part target name as a struct of catalog, schema and table; absent parts are null."""
    parts = F.split(_col(target), "\\.")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("catalog"),
        F.try_element_at(parts, F.lit(2)).alias("schema"),
        F.try_element_at(parts, F.lit(3)).alias("table"),
    )


def subject_name(namespace: Column | str, record: Column | str) -> Column:
    """Namespace tail (from the third part when there are five or more) and kebab-cased record."""
    ns, rec = _col(namespace), _col(record)
    parts = F.split(ns, "\\.")
    tail = F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "."))
    kebab = F.lower(F.regexp_replace(rec, "(?<!^)(?=[A-Z])", "-"))
    return F.concat(F.coalesce(tail, ns), F.lit("."), kebab, F.lit("-value"))

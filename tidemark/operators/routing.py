"""Label filters and routing of rows to several outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def match_labels(
    df: DataFrame,
    eq: Mapping[str, str] | None = None,
    regex: Mapping[str, str] | None = None,
    prefix: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep series by label: equality, whole-value regex, or prefix."""
    for label, value in (eq or {}).items():
        df = df.filter(F.col(label) == value)
    for label, pattern in (regex or {}).items():
        df = df.filter(F.col(label).rlike(f"^(?:{pattern})$"))
    for label, start in (prefix or {}).items():
        df = df.filter(F.col(label).startswith(start))
    return df


def route(df: DataFrame, routes: Mapping[str, Column], out: str = "route") -> DataFrame:
    """One output row per route a row satisfies; rows that satisfy none are left out.

    A condition that is null (for example on a null score) does not route the row.
    """
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in routes.items()]))
    return df.withColumn(out, F.explode(hits))


def split_routes(df: DataFrame, routes: Mapping[str, Column]) -> dict[str, DataFrame]:
    """One DataFrame per route, for callers that write each to its own table."""
    return {name: df.filter(cond) for name, cond in routes.items()}


def extract_field(df: DataFrame, field: str, out: str = "key") -> DataFrame:
    """Use one (possibly nested) field of the value as the record key."""
    return df.withColumn(out, F.col(field).cast("string"))


def select_topics(
    df: DataFrame, include: Sequence[str] = (".*",), exclude: Sequence[str] = (), topic: str = "topic"
) -> DataFrame:
    """Rows of topics that match an include pattern and no exclude pattern (whole-name regex)."""
    name = F.col(topic)
    kept = name.rlike("|".join(f"^(?:{p})$" for p in include))
    return df.filter(kept & ~name.rlike("|".join(f"^(?:{p})$" for p in exclude)) if exclude else kept)


# Names a replication flow leaves out.
INTERNAL_TOPICS = (r".*\.internal", r".*\.replica", r"__.*")


def mirrored_name(alias: str, topic: str = "topic") -> Column:
    """Topic name on the target side: source alias, dot, topic."""
    return F.concat(F.lit(f"{alias}."), F.col(topic))


def mirror(df: DataFrame, alias: str, exclude: Sequence[str] = INTERNAL_TOPICS, topic: str = "topic") -> DataFrame:
    """Rows to replicate, with the topic renamed for the target side."""
    return select_topics(df, exclude=exclude, topic=topic).withColumn(topic, mirrored_name(alias, topic))


def union_normalized(dfs: Sequence[DataFrame], columns: Mapping[str, str]) -> DataFrame:
    """Union inputs of different shape on the named, typed columns; absent ones become null."""
    shaped = [
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        for df in dfs
    ]
    out = shaped[0]
    for df in shaped[1:]:
        out = out.unionByName(df)
    return out

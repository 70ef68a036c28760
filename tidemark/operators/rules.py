"""Alert rules as expressions over raw samples.

A rule compares an expression with a limit; the expression is a tree over counters and gauges as they were sampled. All
rules are planned together: their leaves become one ``at_steps`` over one scan with a window for each distinct look-back, equal
subtrees are one node, and the nodes of each height are one aggregation that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.slices import DEFAULT_SLICE, names
from tidemark.functions.units import micros
from tidemark.operators.alerts import Rule, _COMPARE, alert_sustained
from tidemark.operators.steps import at_steps


@dataclass(frozen=True)
class Series:
    """``take`` of a metric's series over a look-back: last, increase or rate. ``where`` holds (label, value) pairs."""

    metric: str
    take: str = "last"
    lookback: str = "5 minutes"
    where: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Holds:
    """1 where the comparison holds, else 0."""

    of: Expression
    op: str
    limit: float


@dataclass(frozen=True)
class Over:
    """sum, max, min, avg or count of an expression over the series that agree in the labels ``by``."""

    fn: str
    of: Expression
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Math:
    """``+ - * /`` of two expressions where both have a value with the same labels; division by zero has no value."""

    op: str
    left: Expression
    right: Expression


Expression = Series | Holds | Over | Math


@dataclass(frozen=True)
class GraphRule:
    """``expression <op> limit``, held for ``hold_s`` before it fires."""

    rule: str
    expression: Expression
    op: str
    limit: float
    hold_s: int
    severity: str = "alert"


def _parts(e: Expression) -> tuple[Expression, ...]:
    return () if isinstance(e, Series) else (e.left, e.right) if isinstance(e, Math) else (e.of,)


def nodes(rules: Sequence[GraphRule]) -> dict[Expression, int]:
    """The height of each distinct expression; leaves have 0."""
    found: dict[Expression, int] = {}

    def height(e: Expression) -> int:
        if e not in found:
            found[e] = max((height(p) + 1 for p in _parts(e)), default=0)
        return found[e]

    for r in rules:
        height(r.expression)
    return found


_FOLD = {"sum": "s", "max": "hi", "min": "lo", "count": "n"}


def evaluated(samples: DataFrame, rules: Sequence[GraphRule], labels: str | Sequence[str], step: str | int, time: str = "ts",
              value: str = "value", width: str | int = DEFAULT_SLICE) -> DataFrame:
    """(rule, labels, ts, value): each rule's expression at every step at which it has a value.

    ``samples`` has a column ``metric``, the labels, a time and an exact value. Labels that an expression has aggregated
    away are null. A series without a sample in its look-back has no value at that step.
    """
    labels = names(labels)
    ids = {e: i for i, e in enumerate(nodes(rules))}
    heights = nodes(rules)
    leaves = [e for e in ids if isinstance(e, Series)]
    backs = {str(micros(e.lookback)): e.lookback for e in leaves}
    used = samples.filter(F.col("metric").isin(sorted({e.metric for e in leaves})))
    stepped = at_steps(used, ["metric", *labels], step, backs, time, value, width=width)

    def leaf(e: Series) -> Column:
        fits = (F.col("metric") == e.metric) & (F.col("window") == str(micros(e.lookback)))
        for label, wanted in e.where:
            fits &= F.col(label).cast("string") == wanted
        taken = F.col(e.take).cast("double")
        return F.when(fits & taken.isNotNull(), F.struct(F.lit(ids[e]).alias("node"), taken.alias("v")))

    hits = F.array_compact(F.array(*[leaf(e) for e in leaves]))
    known = stepped.select(*labels, "at", F.explode(hits).alias("_n")).select("_n.node", *labels, "at", "_n.v")
    top = max(heights.values())
    for level in range(1, top + 1):
        known = _level(known, level, ids, heights, rules, labels)
    named = F.array_compact(F.array(*[F.when(F.col("node") == ids[r.expression], F.lit(r.rule)) for r in rules]))
    return known.select(F.explode(named).alias("rule"), *labels, F.col("at").alias("ts"), F.col("v").alias("value"))


def _level(known: DataFrame, level: int, ids: dict, heights: dict, rules: Sequence[GraphRule], labels: list[str]) -> DataFrame:
    """The values of all nodes of this height, and of the lower ones that are still needed."""
    here = [e for e in ids if heights[e] == level]
    later = {p for e in ids if heights[e] > level for p in _parts(e)} | {r.expression for r in rules}

    def entry(e: Expression, part: Expression, side: int, kept: Sequence[str], v: Column) -> Column:
        own = [(F.col(c) if c in kept else F.lit(None).cast(known.schema[c].dataType)).alias(c) for c in labels]
        return F.when(F.col("node") == ids[part], F.struct(F.lit(ids[e]).alias("node"), F.lit(side).alias("side"), v.alias("v"), *own))

    def entries() -> Iterator[Column]:
        for e in here:
            if isinstance(e, Holds):
                yield entry(e, e.of, 0, labels, F.when(_COMPARE[e.op](F.col("v"), F.lit(e.limit)), 1.0).otherwise(0.0))
            elif isinstance(e, Over):
                yield entry(e, e.of, 0, e.by, F.col("v"))
            else:
                yield entry(e, e.left, 0, labels, F.col("v"))
                yield entry(e, e.right, 1, labels, F.col("v"))
        for e in later:
            if heights[e] < level:
                yield entry(e, e, 0, labels, F.col("v"))

    rows = known.select("at", F.explode(F.array_compact(F.array(*entries()))).alias("_e")).select("at", "_e.*")
    left, right = F.when(F.col("side") == 0, F.col("v")), F.when(F.col("side") == 1, F.col("v"))
    folded = rows.groupBy("node", *labels, "at").agg(
        F.sum(left).alias("s"), F.max(left).alias("hi"), F.min(left).alias("lo"), F.count(left).alias("n"), F.max(right).alias("r"))
    out = F.col("hi")  # one value: a test, or a node of a lower height
    for e in here:
        if isinstance(e, Over):
            v = F.col("s") / F.col("n") if e.fn == "avg" else F.col(_FOLD[e.fn]).cast("double")
        elif isinstance(e, Math):
            a, b = F.col("hi"), F.col("r")
            v = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e.op]
        else:
            continue
        out = F.when(F.col("node") == ids[e], v).otherwise(out)
    return folded.select("node", *labels, "at", out.alias("v")).filter("v is not null")


def alerts_from_samples(samples: DataFrame, rules: Sequence[GraphRule], labels: str | Sequence[str], step: str | int, time: str = "ts",
                        value: str = "value", max_gap: str | int | None = None, width: str | int = DEFAULT_SLICE) -> DataFrame:
    """Alerts fired by rules over raw samples; as ``alert_sustained``, keyed by rule and labels.

    A run ends at a step at which the comparison does not hold, or where there is no value for longer than ``max_gap``, one and a
    half steps unless given.
    """
    values = evaluated(samples, rules, labels, step, time, value, width).withColumnRenamed("rule", "metric")
    plain = [Rule(r.rule, r.rule, r.op, r.limit, r.hold_s, r.severity) for r in rules]
    return alert_sustained(values, plain, labels, max_gap=max_gap or micros(step) * 3 // 2, width=width)

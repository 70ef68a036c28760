"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by bisection: the
flattest mixture that repeats no source more than a limit, or the one with a wanted entropy. A weight is realised as a
token budget: whole passes over the source's blocks, each in an order of its own, and a last pass that ends where the
budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored

LEVELS = 4  # bisections that one job decides
BINS = 1024


def token_count(text: Column) -> Column:
    """Runs of letters and digits and single other marks, a count near that of subword tokens and without a vocabulary."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\w{1,6}|[^\w\s]")).cast("bigint")


def source_totals(docs: DataFrame, source: str) -> DataFrame:
    """(source, tokens, docs) from (source, tokens); null is a source like any other."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def _state(totals: DataFrame, exponents: list[float], budget: float, whole: float) -> list[tuple[float, float]]:
    """(entropy in nats, largest repetition) of the mixture for each exponent, in one pass over the sources."""
    share = F.col("tokens") / F.lit(whole)
    rows = totals.where("tokens > 0")
    sums = [f for i, a in enumerate(exponents) for f in (
        F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"),
        F.sum(F.pow(share, F.lit(a)) * F.lit(a) * F.log(share)).alias(f"l{i}"),
        F.max(F.pow(share, F.lit(a - 1.0))).alias(f"r{i}"),
    )]
    got = rows.agg(*sums).first()
    out = []
    for i in range(len(exponents)):
        z = got[f"z{i}"]
        out.append((math.log(z) - got[f"l{i}"] / z, got[f"r{i}"] / z * budget / whole) if z else (0.0, 0.0))
    return out


def find_exponent(totals: DataFrame, budget: float, repetition: float | None = 2.0, entropy: float | None = None, rounds: int = 5) -> float:
    """The exponent in [0, 1] to within 2 ** -20.

    With ``entropy`` the one whose mixture has that entropy (nats), else the least one that repeats no source more than
    ``repetition`` times. A target out of reach gives the nearest end. Each round settles four bisections in one job.
    """
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    if not whole:
        return 1.0
    low, high = 0.0, 1.0  # entropy and repetition both fall as the exponent rises
    fine = (lambda e, r: e <= entropy) if entropy is not None else (lambda e, r: r <= repetition)
    if fine(*_state(totals, [0.0], budget, whole)[0]):
        return 0.0
    if not fine(*_state(totals, [1.0], budget, whole)[0]):
        return 1.0
    for _ in range(rounds):
        step = (high - low) / (1 << LEVELS)
        inner = [low + step * i for i in range(1, 1 << LEVELS)]
        good = [fine(*s) for s in _state(totals, inner, budget, whole)]
        first = good.index(True) if True in good else len(inner)
        low, high = low + step * first, low + step * (first + 1)
    return high


def mixture(totals: DataFrame, exponent: float, budget: float) -> DataFrame:
    """(source, tokens, weight, budget): the normalised weight of each source and its tokens of the budget."""
    z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    return totals.select("source", "tokens", weight.alias("weight"), F.round(weight * F.lit(float(budget))).cast("bigint").alias("budget"))


def _last_pass(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows (source, key, place, tokens) of each source's last, partial pass: in order, as long as a row starts within what is left.

    Sums are taken over bins of the order first, so that no source is ordered as a whole: only the rows of the bin in
    which a budget ends are.
    """
    binned = rows.withColumn("bin", F.floor(F.col("place") * BINS).cast("int"))
    bins = binned.groupBy("source", "bin").agg(F.sum("tokens").alias("held"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    bins = bins.join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bins = bins.where(F.col("before") < F.col("left")).select(F.col("source").alias("s"), F.col("bin").alias("b"), "before", "left", (F.col("before") + F.col("held") <= F.col("left")).alias("whole"))
    taken = binned.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    ordered = Window.partitionBy("source", "bin").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    edge = taken.where(~F.col("whole")).withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(ordered), F.lit(0)))
    edge = edge.where(F.col("start") < F.col("left"))
    return taken.where("whole").select(*rows.columns).unionByName(edge.select(*rows.columns))


def mix(docs: DataFrame, key: str, text: str, source: str, budget: float | None = None, repetition: float = 2.0, entropy: float | None = None, block: int = 64, seed: int = 7) -> DataFrame:
    """(key, source, weight, epoch, place): each use of a document in the mixture, in training order of a pass by ``place``.

    ``budget`` is in tokens and is that of the corpus if not given. A pass over a source runs through its blocks in an
    order that depends on the seed, the pass and the block; a block is about ``block`` neighbouring documents in the
    order of a hash, and stays together. A source's last row starts within its budget, so it overruns it by less than a
    document. Null texts have no tokens and take part; a source without tokens has weight 0 and is left out. Rows with
    one key are rows of their own. Null keys and null sources are values like others.
    """
    counted = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), token_count(F.col(text)).alias("tokens")), "tokens")
    totals = stored(source_totals(counted, "source"), "totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(whole if budget is None else budget)
    exponent = find_exponent(totals, budget, repetition, entropy)
    plan = mixture(totals, exponent, budget).join(totals.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.where("tokens > 0 AND budget > 0").withColumn("passes", F.floor(F.col("budget") / F.col("tokens")))
    plan = stored(plan.withColumn("left", F.col("budget") - F.col("passes") * F.col("tokens")), "plan")
    named = plan.select(F.col("source").alias("s"), "weight", "passes", "left", F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).alias("blocks"))
    rows = counted.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    number = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks"))

    def place(epoch: Column) -> Column:
        """In [0, 1): by the block's hash, inside a block by the document's."""
        by_block = F.pmod(F.xxhash64("source", number, epoch, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        inside = F.pmod(F.xxhash64("key", epoch), F.lit(1 << 10)) / F.lit(float(1 << 50))
        return by_block + inside

    epochs = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    full = rows.withColumn("epoch", F.explode(epochs)).select("key", "source", "weight", "epoch", place(F.col("epoch")).alias("place"))
    partial = rows.where(F.col("left") > 0).select("key", "source", "weight", F.col("passes").alias("epoch"), place(F.col("passes")).alias("place"), "tokens")
    last = _last_pass(partial, plan.where(F.col("left") > 0))
    out = full.unionByName(last.select(*full.columns))
    return out.select(F.col("key").alias(key), F.col("source").alias("source"), F.round("weight", 9).alias("weight"), F.col("epoch").cast("bigint").alias("epoch"), "place")

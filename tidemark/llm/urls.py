"""URL filters: suffix and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are trained from the URLs that the rules decide. Features and rules are SQL expressions and the trees are
the JVM's own, so no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import stored

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that the result must follow.
RULES = (
    UrlRule("org", "/", ALLOW), UrlRule("example.org", "/es/", BLOCK), UrlRule("example.org", "/en/1", BLOCK),
    UrlRule("com", "/fr/", ALLOW), UrlRule("com", "/de/", BLOCK),
)
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "path_digit_ratio", "entropy", "host_entropy",
    "parameters", "query_length", "has_fragment", "hyphens", "secure", "suffix_length", "suffix_hash", "suffix_share", "suffix_mean_length",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host behind the first ``://`` and the path up to ``?`` or ``#``; both empty without ``://`` or url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits (struct of name and verdict), or null; equally long ones by name."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character over letters, digits and the marks of URLs."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%":
        share = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / size
        total = total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return total


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Host, path and the features that need only the URL itself."""
    text = F.lower(F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col(url))
    df = urls.withColumns({"host": host, "path": path})
    h, p = F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    suffix = F.substring_index(h, ".", -1)
    return df.withColumns({
        "suffix": suffix,
        "url_length": F.length(text), "host_length": F.length(h), "path_length": F.length(p),
        "depth": F.regexp_count(p, F.lit("/[^/]+")), "labels": F.regexp_count(h, F.lit(r"[^.]+")),
        "digit_ratio": _share(text, "[0-9]"), "path_digit_ratio": _share(p, "[0-9]"),
        "entropy": _entropy(text), "host_entropy": _entropy(h),
        "parameters": F.regexp_count(query, F.lit("[^&]+")), "query_length": F.length(query),
        "has_fragment": F.contains(text, F.lit("#")).cast("int"), "hyphens": F.regexp_count(text, F.lit("[-_]")),
        "secure": text.startswith("https:").cast("int"), "suffix_length": F.length(suffix),
        "suffix_hash": F.pmod(F.xxhash64(suffix), F.lit(31)),
    })


def with_suffix_statistics(df: DataFrame) -> DataFrame:
    """Share of all URLs and mean length by suffix, over all rows. The hot suffix is combined before the shuffle."""
    stats = df.groupBy("suffix").agg(F.count("*").alias("suffix_n"), F.avg("url_length").alias("suffix_mean_length"))
    total = df.agg(F.count("*").alias("total_n")).first()["total_n"]
    return df.join(stats, "suffix").withColumn("suffix_share", F.col("suffix_n") / F.lit(max(total, 1)))


def _vectors(df: DataFrame) -> DataFrame:
    ready = df.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)


def train(labelled: DataFrame, limit: int = 10_000, trees: int = 20, depth: int = 4, seed: int = 17) -> GBTClassificationModel | None:
    """Trees from rows with a ``verdict``; null if only one verdict occurs.

    ``limit`` bounds the training rows: those with the smallest hash of their URL, so that the sample depends on
    nothing but the data. The sample is ordered and in one partition, which makes the trees repeatable.
    """
    rows = labelled.where(F.col("verdict").isNotNull()).withColumn("label", (F.col("verdict") == ALLOW).cast("double"))
    sample = rows.withColumn("h", F.xxhash64("url", F.lit(seed))).orderBy("h", "url").limit(limit)
    sample = stored(sample.select("h", "url", "label", *FEATURES), "urls").coalesce(1).sortWithinPartitions("h", "url")
    sample = _vectors(sample).select("features", "label")
    if sample.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, stepSize=0.2).fit(sample)


def judge(pages: DataFrame, key: str, url: str, rules: tuple[UrlRule, ...] = RULES, limit: int = 10_000) -> DataFrame:
    """Host, path, the rule that fits, and the verdict: the rule's, else that of the trees.

    A null URL has an empty host and path and is judged by the trees. Where the rules decide no URL of one of the
    verdicts there is nothing to learn, and the rest is allowed. Repeated rows stay; other columns are not read.
    """
    df = lexical(pages.select(F.col(key).alias(key), F.col(url).alias("url")), "url")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": fit["rule"], "verdict": fit["verdict"]})
    df = with_suffix_statistics(df)
    model = train(df, limit)
    if model is None:
        out = df.withColumn("allow_score", F.lit(1.0))
    else:
        out = model.transform(_vectors(df)).withColumn("allow_score", vector_to_array("probability")[1])
    other = F.when(F.col("allow_score") >= 0.5, ALLOW).otherwise(BLOCK)
    return out.select(key, "host", "path", "rule", F.coalesce("verdict", other).alias("verdict"), F.round("allow_score", 6).alias("allow_score"))

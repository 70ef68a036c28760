"""Secret scans over the history of a repository, kept up to date by a ledger of scanned blobs.

Every version's content is named by its SHA-256. A blob is scanned once for each rule and rule version, however
many paths and versions hold it; findings are joined back to all of them. Everything is SQL expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """``group`` of a match needs ``least`` characters, or the match is dropped and the search goes on behind it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The three kinds that the result must have, in this order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same as any length with those under 20 characters dropped
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"))
RULES = BASE + MORE


def blob_name(content: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 256)


def _matches(rule: Rule, text: Column) -> Column:
    """Length of the gap before each match, of the match, and whether it is kept."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, 0)
    tested = F.regexp_extract_all(text, pattern, rule.group) if rule.group else whole
    row = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        tested,
        lambda s, t: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(t) >= rule.least).alias("kept")),
    )
    return F.when(text.rlike(rule.pattern), row)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, rank, start, end) of every match in ``blobs`` (blob, content, and ``seen`` if some rules are done).

    Matches of one kind are leftmost and do not overlap; offsets count code points, the end is exclusive.
    """
    text = F.coalesce("content", F.lit(""))
    done = F.col("seen") if "seen" in blobs.columns else None
    kinds = []
    for i, rule in enumerate(rules):
        found = _matches(rule, text)
        if done is not None:
            found = F.when(~F.coalesce(F.array_contains(done, f"{rule.kind}@{rule.version}"), F.lit(False)), found)
        kinds.append(F.struct(F.lit(rule.kind).alias("kind"), F.lit(i).alias("rank"), found.alias("found")))
    rows = blobs.select("blob", F.explode(F.array(*kinds)).alias("k")).where(F.size("k.found") > 0)
    rows = rows.select("blob", "k.kind", "k.rank", F.posexplode("k.found").alias("i", "m"))
    before = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    return (
        rows.withColumn("end", end)
        .where("m.kept")
        .select("blob", "kind", "rank", (F.col("end") - F.col("m.size")).alias("start"), "end")
    )


def unseen_blobs(versions: DataFrame, content: str, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per distinct content that some rule version has not seen: blob, content, and the pairs it has (``seen``).

    ``ledger`` has (blob, kind, version) of every pair scanned. Copies are dropped before the shuffle as well.
    """
    blobs = versions.select(blob_name(F.col(content)).alias("blob"), F.col(content).alias("content")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs
    wanted = [f"{r.kind}@{r.version}" for r in rules]
    pairs = ledger.select("blob", F.concat_ws("@", "kind", F.col("version").cast("string")).alias("pair")).where(F.col("pair").isin(wanted))
    seen = pairs.groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    return blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(wanted))


def ledger_rows(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The (blob, kind, version) pairs that scanning ``blobs`` has completed; append them to the ledger."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return blobs.select("blob", F.inline(pairs))


def by_blob(findings: DataFrame) -> DataFrame:
    """One row per blob with its spans by start, then kind."""
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings_by_path(versions: DataFrame, path: str, content: str, findings: DataFrame) -> DataFrame:
    """Every version of every path with what its blob holds: counts per base kind, digest, all spans.

    A version without content counts as empty; repeated paths stay repeated rows; extra columns are not read.
    """
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    named = versions.select(F.col(path).alias(path), blob_name(F.col(content)).alias("blob"))
    rows = named.join(by_blob(findings), "blob", "left").withColumn("spans", spans)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return rows.select(
        path,
        *[F.size(F.filter("spans", _is(r.kind))).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def scan_versions(versions: DataFrame, path: str, content: str, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run: (rows by path, new findings, new ledger rows). Earlier ``findings`` are joined back as well."""
    blobs = unseen_blobs(versions, content, ledger, rules)
    new = scan_blobs(blobs, rules)
    known = new if findings is None else findings.unionByName(new)
    return findings_by_path(versions, path, content, known), new, ledger_rows(blobs, rules)


def without_secrets(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all rows and columns, with the spans found in their text replaced; overlapping spans by one mark.

    Each distinct text is scanned once. Texts without secrets, null ones too, stay as they are.
    """
    spans = scan_blobs(unseen_blobs(docs.select(F.col(text).alias("content")), "content", None, rules), rules)
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0))).where("end > reach")
    spans = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(F.greatest("start", "reach").alias("start"), "end"))).alias("spans"))
    spans = stored(spans, "spans")
    whole, cuts = docs[text], spans["spans"]
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cuts, lambda s: s["end"]))
    starts = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length(whole).cast("bigint")))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(whole, e.cast("int") + 1, (s - e).cast("int")))
    cut = F.when(cuts.isNotNull(), F.array_join(pieces, mark)).otherwise(whole)
    joined = docs.join(spans, blob_name(whole) == spans["blob"], "left")
    return joined.select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])

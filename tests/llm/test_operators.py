"""Operators against plain versions on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import collections

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tidemark.llm import decontaminate, minhash, mixing, secret_scan, simhash, suffixes, tokens, urls
from tidemark.llm.common import stored

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
ITEMS = [(1, "Alpha beta gamma, delta EPSILON zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, "uno dos"), (5, "!"), (5, "uno dos"), (None, "tres cuatro")]


def by_row(df, *columns):
    return collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in df.collect())


def empty(df):
    return df.where("false")


def test_secrets_by_path(table, texts):
    out = secret_scan.scan_versions(table(texts), "doc_id", "text")[0]
    assert by_row(out, "n_assign", "n_access", "n_hex", "base_sha256") == collections.Counter((k, *plain.secrets(t)) for k, t in texts)
    assert secret_scan.scan_versions(empty(table(texts)), "doc_id", "text")[0].count() == 0


def test_only_unseen_pairs_are_scanned(table):
    first = table([(1, "token=abcdef1"), (2, "token=abcdef1")])
    _, found, ledger = secret_scan.scan_versions(first, "doc_id", "text")
    found, ledger = stored(found, "f"), stored(ledger, "l")
    assert ledger.count() == len(secret_scan.RULES) and found.count() == 1
    both = first.union(table([(3, "AKIA" + "Z" * 16)]))
    rows, new, pairs = secret_scan.scan_versions(both, "doc_id", "text", ledger, found)
    assert [r["kind"] for r in new.collect()] == ["access"] and pairs.count() == len(secret_scan.RULES)
    assert {r["doc_id"]: r["spans"] for r in rows.collect()} == {1: "assign:0:13", 2: "assign:0:13", 3: "access:0:20"}
    newer = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, r.least, 2 if r.kind == "hex" else 1) for r in secret_scan.RULES)
    again = secret_scan.unseen_blobs(first, "text", ledger, newer)
    assert again.count() == 1 and secret_scan.scan_blobs(again, newer).count() == 0


def test_secrets_are_cut(table):
    out = secret_scan.without_secrets(table([(1, "é password=0123456789abcdef0123456789 x"), (2, None), (3, "")]), "doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "é [SECRET] x", 2: None, 3: ""}
    assert len(out.columns) == len(table([]).columns)


def test_edited_texts(table, texts):
    rows = list({k: t for k, t in texts}.items())
    out = simhash.edited_neighbours(table(rows), "doc_id", "text").collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in out} == plain.edited(rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    same = collections.defaultdict(set)
    for r in out:
        same[dict(rows)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    repeated = simhash.edited_neighbours(table([*texts, (None, "x"), (None, None)]), "doc_id", "text")
    assert repeated.count() == len(texts) + 2
    assert simhash.edited_neighbours(empty(table(texts)), "doc_id", "text").count() == 0
    one = simhash.edited_neighbours(table([(7, "abcd")]), "doc_id", "text").first()
    assert one["edited_sha256"] == plain.sha("abab") and one["near_next"] == 1.0


def test_fingerprints_within_the_radius(spark):
    import random

    rng = random.Random(1)
    prints = [rng.getrandbits(128) for _ in range(200)]
    for p in prints[:60]:
        for flips in (1, 2, 3, 4):
            q = p
            for bit in rng.sample(range(128), flips):
                q ^= 1 << bit
            prints.append(q)
    rows = [(bytearray(p.to_bytes(16)),) for p in prints + prints[:5]] + [(None,)]
    got = {(bytes(r["low"]), bytes(r["high"]), r["bits"]) for r in simhash.near_pairs(spark.createDataFrame(rows, "fingerprint binary"), 3, 5).collect()}
    signed = lambda p: tuple(int.from_bytes(p.to_bytes(16)[i : i + 8], signed=True) for i in (0, 8))
    want = {(a.to_bytes(16), b.to_bytes(16), (a ^ b).bit_count()) for a in set(prints) for b in set(prints) if signed(a) < signed(b) and (a ^ b).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame(rows, "fingerprint binary"), 5, 5)


def test_near_duplicates(table, texts):
    out = minhash.near_duplicates(table(texts), "doc_id", "text")
    want = collections.Counter((k, len(plain.shingles(t)), c, k == c) for (k, t), c in zip(texts, plain.components(texts)))
    assert by_row(out, "n_shingles", "component_id", "kept") == want
    assert minhash.near_duplicates(empty(table(texts)), "doc_id", "text").count() == 0
    null = minhash.near_duplicates(table([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, None)]), "doc_id", "text")
    assert by_row(null, "component_id", "kept") == collections.Counter({(None, 3, False): 1, (3, 3, True): 1, (None, None, True): 1})


def test_chain_without_a_common_neighbour(table):
    """Each text is linked with the next one only, so neither hubs nor one round connect them."""
    rows = [(100 - i, " ".join(f"w{j}" for j in range(8 * i, 8 * i + 200))) for i in range(24)]
    out = minhash.near_duplicates(table(rows), "doc_id", "text")
    assert [r["component_id"] for r in out.collect()] == [77] * 24 == plain.components(rows)


def test_tokens(table, texts):
    library = tokens.vocabulary(VOCABULARY)
    rows = [*texts, (60, "it's <|endoftext|><|startoftext|> ok"), (61, "İ᪺ Σς \x1c x²½ ①٣ <| end |>"), (None, "null id")]
    out = tokens.count_tokens(table(rows), "doc_id", "text", VOCABULARY, 100)
    counted = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert by_row(out, "n_bytes", "n_tokens", "over_limit") == collections.Counter((k, len((t or "").encode()), n, n > 100) for (k, t), n in zip(rows, counted))
    assert tokens.count_tokens(empty(table(texts)), "doc_id", "text", VOCABULARY).count() == 0


def test_every_shortcut_is_one_token():
    counter = tokens.TokenCounter(VOCABULARY)
    some = list(counter.whole)[::97]
    assert len(counter.whole) > 20_000 and counter.count([" ".join(some)]) == [len(some)]


def test_passages(table, texts):
    out = suffixes.remove_repeats(table(texts), "doc_id", "text", keep_text=True)
    want = collections.Counter((k, *u) for (k, _), u in zip(texts, plain.uncovered(texts)))
    assert by_row(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(plain.sha(bytes(r["kept"])) == r["kept_sha256"] for r in out.collect())
    assert suffixes.remove_repeats(empty(table(texts)), "doc_id", "text").count() == 0
    null = suffixes.remove_repeats(table([(None, "x" * 80), (9, "x" * 60), (None, None)]), "doc_id", "text")
    assert by_row(null, "n_removed") == collections.Counter({(None, 80): 1, (9, 0): 1, (None, 0): 1})


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks(spark, table, limit):
    items = spark.createDataFrame([(*i, "?") for i in ITEMS], "item_id int, text string, key string")
    rows = [(1, "Alpha! BETA gamma delta epsilon zeta eta theta iota kappa; lambda mu. nu"), (2, "uno, DOS uno dos uno"), (3, None), (4, ""), (5, "dos uno"), (2, "uno dos"), (2, "uno dos"),
            (None, "tres cuatro"), (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (7, "xÉuno dos uno\x1fdos")]
    marked = decontaminate.mark_hits(table(rows), "doc_id", "text", items, "item_id", "text", set_limit=limit)
    want = collections.Counter()
    for k, t in rows:
        n, hit, _, _, bad = plain.leaks(t, ITEMS)
        named = sorted({str(i) for i, body in ITEMS if i is not None and plain.leaks(t, [(i, body)])[4]})
        want[k, n, hit, len(named), plain.sha(",".join(named)), bad] += 1
    assert by_row(decontaminate.report(marked, "doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert decontaminate.mark_hits(empty(table(rows)), "doc_id", "text", items, "item_id", "text", set_limit=limit).count() == 0
    none = decontaminate.report(decontaminate.mark_hits(table(rows), "doc_id", "text", empty(items), "item_id", "text", set_limit=limit), "doc_id")
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_passages_of_the_benchmark_are_cut(spark, table):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = [(1, "-- Nu xi omicron uno, dos. Pi rho sigma"), (2, "uno dos"), (3, None), (4, "nu xi"), (5, "uno, dos. Rho sigma tau")]
    out = decontaminate.decontaminate(table(rows), "doc_id", "text", items, "item_id", "text")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "-- Nu xi omicron Pi rho sigma", 3: None, 4: "nu xi", 5: "Rho sigma tau"}
    assert out.columns == table(rows).columns


def test_urls(spark):
    rows = [(1, "https://A.example.org/es/1?x#y"), (2, "http://example.org/en/12"), (3, "http://x.org"), (4, None), (5, "no scheme"), (6, "x://m.COM/fr/1"), (7, "x://notcom/fr/"),
            (8, "x://a.com/de/?q"), (8, "x://a.com/de/?q"), (9, "://"), (10, "http://b.net/en/1"), (11, "https://c.example.org/en/2/a://b/es/")]
    rows += [(i, f"http://h{i % 7}.example.{('org', 'com', 'net')[i % 3]}/{('de', 'fr', 'en')[i % 4 % 3]}/{i}") for i in range(20, 120)]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id bigint, url string, host string, suffix string")
    out = urls.judge(df, "page_id", "url").collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r["page_id"]].add((r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None))
    assert len(out) == len(rows) and {r["verdict"] for r in out} <= {"allow", "block"}
    want = {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("x.org", "", None, None), 4: ("", "", None, None), 5: ("", "", None, None),
            6: ("m.com", "/fr/1", "com/fr/", "allow"), 7: ("notcom", "/fr/", None, None), 8: ("a.com", "/de/", "com/de/", "block"), 9: ("", "", None, None), 10: ("b.net", "/en/1", None, None),
            11: ("c.example.org", "/en/2/a://b/es/", "org/", "allow")}
    assert {k: next(iter(got[k])) for k in want} == want
    assert urls.judge(empty(df), "page_id", "url").count() == 0
    single = urls.judge(df.where("page_id = 4"), "page_id", "url").first()
    assert single["verdict"] == "allow"  # nothing to learn from


def _mixed(table, rows, **options):
    return mixing.mix(table(rows), "doc_id", "text", "source", **options).collect()


def test_mixture_keeps_to_budgets(table):
    rows = [(i, "w " * 10, "large") for i in range(300)] + [(1000 + i, "w " * 10, "small") for i in range(20)] + [(2000, None, "void"), (None, "w " * 10, None), (2001, "", None)]
    out = _mixed(table, rows, repetition=2.0)
    uses = collections.Counter((r["source"], r["doc_id"]) for r in out)
    assert max(uses.values()) <= 2 and "void" not in {s for s, _ in uses}
    tokens_of = collections.Counter()
    for (source, key), n in uses.items():
        tokens_of[source] += 10 * n * (key != 2001)
    weights = {r["source"]: r["weight"] for r in out}
    assert abs(sum(weights.values()) - 1) < 1e-6
    for source, weight in weights.items():
        assert weight * 3210 - 10 <= tokens_of[source] <= weight * 3210 + 20
    assert tokens_of["small"] > 200  # more than its share
    passes = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r["place"]):
        passes[r["source"], r["epoch"]].append(r["doc_id"])
    assert len(set(passes["small", 0])) == 20 and all(len(p) == len(set(p)) for (s, _), p in passes.items() if s)
    assert _mixed(table, []) == [] and _mixed(table, [(1, None)]) == []


def test_exponent_meets_the_target(spark):
    import math

    totals = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1), ("d", 0, 1)], "source string, tokens bigint, docs bigint")
    share = [0.9, 0.09, 0.01]

    def weights(a):
        z = sum(s**a for s in share)
        return [s**a / z for s in share]

    a = mixing.find_exponent(totals, 1000, repetition=3.0)
    assert abs(max(w / s for w, s in zip(weights(a), share)) - 3) < 1e-3
    b = mixing.find_exponent(totals, 1000, entropy=0.8)
    assert abs(-sum(w * math.log(w) for w in weights(b)) - 0.8) < 1e-3
    assert mixing.find_exponent(totals, 1000, repetition=1000.0) == 0.0 and mixing.find_exponent(totals, 1000, repetition=0.5) == 1.0


def test_native_plans_run_no_python(spark, table, texts):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    frames = [secret_scan.scan_versions(table(texts).where(F.col("doc_id") > 0), "doc_id", "text")[0], decontaminate.mark_hits(table(texts), "doc_id", "text", items, "item_id", "text")]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan

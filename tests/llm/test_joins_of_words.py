"""The n-gram join and the spelling variants against plain versions, with odd rows, ties and hot groups."""

import collections
import random
import re
import zlib

import pytest

from tests.llm import plain
from tidemark.llm import prefixes, spellings

ACCENTS = "abcdeéßñ"


def gram_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(plain.LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def plain_join(rows, width, percent):
    sets = [gram_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(filter(lambda k: k is not None, (least.get(root(i)), key)), default=None)
    return collections.Counter((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def joined(table, rows, width, percent):
    out = prefixes.join_components(table(rows), "doc_id", "text", width, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return collections.Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("width,percent", [(3, 90), (3, 70), (1, 80), (2, 50)])
def test_join_against_plain(table, texts, width, percent):
    rows = [*texts, (None, texts[0][1]), (None, None), (None, "one two"), (99, "ONE  two")]
    assert joined(table, rows, width, percent) == plain_join(rows, width, percent)


def test_chains_that_hubs_leave_apart(table, monkeypatch):
    """Each text is similar to the next alone, all share frequent elements; small blocks, no elements listed beside a class."""
    monkeypatch.setattr(prefixes, "ROWS", 3)
    monkeypatch.setattr(prefixes, "HUBS", 1)
    monkeypatch.setattr(prefixes, "FEW", 1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = [*words[:2], *words[5:], *(f"x{i}y{j}" for j in range(3))] if i % 9 else [*words[:60], *(f"z{i}y{j}" for j in range(60))]
    random.Random(3).shuffle(rows)
    want = plain_join(rows, 3, 90)
    assert 4 < len({c for _, _, c in want}) < 30 and joined(table, rows, 3, 90) == want
    monkeypatch.setattr(prefixes, "LISTED", 0)
    assert joined(table, rows, 3, 90) == want


def test_small_parts_and_many_buckets(table, texts, monkeypatch):
    monkeypatch.setattr(prefixes, "PART", 2000)
    monkeypatch.setattr(prefixes, "BUCKET", 100)
    assert joined(table, texts, 3, 90) == plain_join(texts, 3, 90)


def test_join_of_nothing(table):
    assert not joined(table, [], 3, 90) and joined(table, [(1, None), (2, "")], 3, 90) == collections.Counter([(1, 0, 1), (2, 0, 2)])


def test_a_group_of_near_copies_is_not_squared(table, monkeypatch):
    """Copies of one text with an edit each: the pairs that are compared grow with the group, not with its square."""
    compared, linked, rng = [], prefixes._linked, random.Random(5)
    monkeypatch.setattr(prefixes, "_linked", lambda pairs, *a: (compared.append(pairs.count()), linked(pairs, *a))[1])
    totals = []
    for n in (100, 400):
        compared.clear()
        rows = []
        for i in range(n):
            words = [f"w{j}" for j in range(200)]
            words[rng.randrange(200)] = f"new{i}"
            rows.append((i, " ".join(words)))
        assert {r[2] for r in joined(table, rows, 3, 90)} == {0}
        totals.append(sum(compared))
    assert totals[1] < 6 * totals[0] and totals[1] < 400 * 8


def plain_words(rows, every=31):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain.LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def plain_variants(n, factor=10):
    near = collections.defaultdict(list)
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) < 2 and plain.lexicographic_distance(a, b)[-1] == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= factor * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root)
    return out


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("tile", [2, 256])
def test_variants_against_plain(spark, monkeypatch, tile):
    """Words of few letters have many near words and anagrams; counts by powers of ten make chains of forms and ties."""
    monkeypatch.setattr(spellings, "TILE", tile)
    monkeypatch.setattr(spellings, "CHUNK", 40 * tile)
    rng, words = random.Random(tile), set()
    while len(words) < 60:
        words.add("".join(rng.choice(ACCENTS) for _ in range(rng.randrange(7, 12))))
    for _ in range(500):
        w, at = rng.choice(sorted(words)), rng.randrange(7)
        words.add(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(ACCENTS) + w[at:], w[:at] + rng.choice(ACCENTS) + w[at + 1 :], w[:at] + w[at + 1] + w[at] + w[at + 2 :] if at < len(w) - 1 else w]))
    n = {w: 10 ** rng.randrange(5) for w in words}
    want = plain_variants(n)
    assert sum(v[2] is not None for v in want.values()) > 50 and any(want[v[2]][2] for v in want.values() if v[2])
    assert found(spellings.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"))) == want


def test_words_of_documents(table, texts):
    rng, long = random.Random(6), "wonderful wanderful Wonderful ÀWONDERful×÷ " * 3000
    rows = [*texts, (None, "Strasse-Strasse, straßeee straßeee"), (None, None), (70, long), (71, ""), (72, "_under_scores_ under2scores")]
    rows += [(i, " ".join(rng.choice(["spelling", "speling", "spellings", "Spelling", "sqelling"]) for _ in range(30))) for i in range(100, 160)]
    for every in (0, 3, 31):
        n = plain_words(rows, every)
        got = spellings.vocabulary(table(rows), "doc_id", "text", every=every)
        assert {r["word"]: r["n"] for r in got.collect()} == n
    assert found(spellings.variants(got)) == plain_variants(n)


def test_variants_of_nothing(table):
    assert not found(spellings.variants(spellings.vocabulary(table([]), "doc_id", "text")))
    assert not found(spellings.variants(spellings.vocabulary(table([(1, None), (2, "short words of no use")]), "doc_id", "text")))

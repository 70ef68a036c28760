import pytest


CLASHES = ("key", "part", "words", "blob", "spans", "content", "label", "name", "hits", "score", "cls", "tokens", "least", "node", "s", "drop")


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (doc_id, text, lang, source) rows with extra columns whose names the operators use inside."""
    def build(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), *["?"] * len(CLASHES)) for r in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES))

    return build


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and long texts, repeated rows and ids, near copies, shared passages."""
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß🙂xyz") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(400), prose(30)
    rows = [(1, base), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "One"), (7, "a b c d"), (8, prose(3000))]
    for i in range(10, 22):  # near copies, each other than the next
        own = base.split(" ")
        for _ in range(rng.randrange(0, 8)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(i, prose(40) + " " + passage.upper() * (i % 2) + passage + ". " + prose(20)) for i in range(30, 42)]
    rows += [(50, base), (50, base), (51, "password = 'abcdef12' x token:ab secret=token:abcdef AKIA" + "A1" * 9 + " " + "0a" * 15 + " AKIAAKIA1")]
    rows += [(52, "é" * 60 + "0" * 30 + "aa " * 100), (53, "é" * 55 + "aa " * 90), (54, "Annt " * 200), (55, "Annt " * 150)]
    return rows

"""SQL of the operators that SQL can express, written from the results' definitions."""

from __future__ import annotations

_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["''']?\x20*[:=]\x20*["''']?([A-Za-z0-9+/_.=-]+)""".replace("'''", "''"), 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
)


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, start, start + n AS stop FROM (
  SELECT rid, i, length(whole[i]) AS n, length(tested[i]) AS k,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, gaps, whole, tested, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT rid, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS tested FROM d
    WHERE regexp_matches(t, '{pattern}')))) WHERE k >= {least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_kind(i, *k) for i, k in enumerate(_KINDS))}),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS every FROM s GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _similar(words: int, percent: int, more: str) -> str:
    """Components of documents whose sets of shingles of so many words agree to so many parts in a hundred."""
    return rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' ')) END) AS sh FROM w),
x AS MATERIALIZED (SELECT rid, len(sh) AS n, unnest(sh) AS shingle FROM s),
e AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r(rid, node) AS (SELECT rid, rid FROM s UNION SELECT r.rid, e.b FROM r JOIN e ON r.node = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id{more} FROM s
JOIN (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN s o ON o.rid = r.node GROUP BY r.rid) c USING (rid)
"""


NEAR_DUPLICATES = _similar(5, 85, ", c.component_id = s.doc_id AS kept")
NGRAM_JOIN = _similar(3, 90, "")

PASSAGES = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS win FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
c AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM w JOIN f USING (win) WHERE first < doc_id),
n AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM c),
r AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY rid, run),
g AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS prev FROM r),
k AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
  FROM g JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

LEAKS = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(words[k:k + n - 1], ' ') AS win FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT rid, n, k, array_to_string(words[k:k + n - 1], ' ') AS win FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS MATERIALIZED (SELECT rid, k, n, item_id FROM dw JOIN iw USING (n, win)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

HARD_NEGATIVES = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid AS arid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id IS DISTINCT FROM b.vec_id) AND len(a.x) = len(b.x)),
p AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, other_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# A checksum over the bytes of a text, by a table that follows from the polynomial.
SPELLINGS = r"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM range(256) AS r(b)),
o AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS MATERIALIZED (SELECT id, run, count(*) AS k FROM o WHERE length(run) >= 7 GROUP BY id, run),
y AS (SELECT run, k, hex(encode(id || ':' || run)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(length(bytes) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', bytes[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', bytes[2 * i + 2]) - 1),
  lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM y, t),
c AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
g AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] AS head, word[i + 1:] AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM g a JOIN g b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word < b.word
  UNION SELECT g.word, g.n, w.word, w.n FROM g JOIN w ON g.head || g.tail = w.word),
b AS (SELECT a AS word, b AS near, nb AS near_n FROM e UNION SELECT b, a, na FROM e),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.m >= 10 * w.n THEN s.near END AS form, CASE WHEN s.m >= 10 * w.n THEN s.m END AS form_n
  FROM w LEFT JOIN (SELECT word, count(*) AS n_near, max(near_n) AS m, min(near) FILTER (near_n = top) AS near FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM b) GROUP BY word) s USING (word)),
z AS (WITH RECURSIVE x(word, last) AS (SELECT word, word FROM f UNION ALL SELECT x.word, f.form FROM x JOIN f ON x.last = f.word WHERE f.form IS NOT NULL) SELECT x.word, x.last AS root FROM x JOIN f ON x.last = f.word WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN z USING (word)
"""

SQL = {
    "op1_secret_scans": SECRETS, "op3_minhash_near_dedup": NEAR_DUPLICATES, "op8_suffix_array_dedup": PASSAGES, "op10_benchmark_decontamination": LEAKS,
    "op11_hard_negatives": HARD_NEGATIVES, "op12_ngram_join": NGRAM_JOIN, "op13_spelling_variants": SPELLINGS,
}

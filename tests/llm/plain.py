"""Plain versions of the operators' results, for tables that fit in memory. Rows are (doc_id, text)."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def secrets(text: str | None) -> tuple:
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = collections.Counter(f[2] for f in found)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)))


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(rows: list[tuple]) -> list[int]:
    """For each row the least id that links reach."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return [least[root(i)] for i in range(len(rows))]


def uncovered(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, digest of what is left) of each row."""
    texts = [(t or "").encode() for _, t in rows]
    first: dict[bytes, int] = {}
    for (key, _), data in sorted(zip(rows, texts), key=lambda x: x[0][0]):
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], key)
    out = []
    for (key, _), data in zip(rows, texts):
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < key:
                covered[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(covered.astype(int), prepend=0) == 1))
        out.append((len(data), int(covered.sum()), spans, sha(np.frombuffer(data, np.uint8)[~covered].tobytes())))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(text: str | None, items: list[tuple], n: int = 10) -> tuple:
    """(n_words, n_hit, n_items, digest, contaminated) of one text."""
    own, hit, found = words(text), set(), set()
    windows: dict[tuple, set[str]] = {}
    for item, body in items:
        whole = words(body)
        size = min(n, len(whole))
        for k in range(len(whole) - size + 1 if size else 0):
            windows.setdefault(tuple(whole[k : k + size]), set()).add(str(item))
    for size in {len(w) for w in windows}:
        for i in range(len(own) - size + 1):
            named = windows.get(tuple(own[i : i + size]))
            if named:
                hit.update(range(i, i + size))
                found |= named
    return len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def edited(rows: list[tuple]) -> dict[int, tuple]:
    """(n_chars, digest of the edited text) by id, for distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[key] = (len(text), sha(text[: len(text) - half] + after[:half]))
    return out


def lexicographic_distance(a: str, b: str) -> list[int]:
    """The last row of the edit-distance table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row

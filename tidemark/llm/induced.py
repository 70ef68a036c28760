"""Suffix order of a shard by external induced sorting, to the depth that the matches need.

The leftmost suffixes of S-type (LMS) are dealt into queues by their leading bytes and sorted queue by queue; from
them the other suffixes are induced, first the L-types in rising, then the S-types in falling order. A queue holds the
positions that belong to one leading byte in the order in which they were induced, which is their order; what exceeds
its share of memory goes to an unnamed file that ends with the task. All steps work on blocks of positions.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20


class Queue:
    """First in, first out, of blocks of 64-bit positions; at most ``held`` of them are in memory."""

    def __init__(self, held: int = BLOCK):
        self.held, self.blocks, self.size, self.file, self.lengths, self.read = held, [], 0, None, [], 0

    def put(self, block: np.ndarray) -> None:
        if not len(block):
            return
        self.blocks.append(block)
        self.size += len(block)
        if self.size > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            joined = np.concatenate(self.blocks)
            self.file.seek(0, 2)
            joined.tofile(self.file)
            self.lengths.append(len(joined))
            self.blocks, self.size = [], 0

    def take(self) -> Iterator[np.ndarray]:
        """All blocks in order, those put meanwhile too."""
        while True:
            if self.lengths:
                n = self.lengths.pop(0)
                self.file.seek(8 * self.read)
                self.read += n
                yield np.fromfile(self.file, np.int64, n)
            elif self.blocks:
                block = np.concatenate(self.blocks)
                self.blocks, self.size = [], 0
                yield block
            else:
                return

    def reversed(self) -> Iterator[np.ndarray]:
        """All blocks from the last to the first, each in falling order; the queue keeps them."""
        if self.blocks:
            yield np.concatenate(self.blocks)[::-1]
        end = self.read + sum(self.lengths)
        for n in self.lengths[::-1]:
            self.file.seek(8 * (end - n))
            end -= n
            yield np.fromfile(self.file, np.int64, n)[::-1]


def _types(text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it (S-type); a string's last one is not."""
    n = len(text)
    after = np.append(text[1:], 0).astype(np.int16)
    step = np.sign(after - text)
    step[last] = -1
    told = np.where(step != 0, np.arange(n), n)
    told = np.minimum.accumulate(told[::-1])[::-1]
    return step[told] > 0


def _by_bytes(text: np.ndarray, left: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` bytes; a string that ends counts as smaller than any that goes on."""
    out = []
    for order in _dealt(text, left, at, 0, depth):
        reach = np.minimum(left[order], depth)
        key = np.zeros((len(order), depth + 1), np.uint8)
        here = order[:, None] + np.arange(depth)
        key[:, :depth] = np.where(np.arange(depth) < reach[:, None], text[np.minimum(here, len(text) - 1)], 0)
        key[:, depth] = reach + 1
        out.append(order[np.argsort(key.reshape(-1).view(f"S{depth + 1}"), kind="stable")])
    return np.concatenate(out) if out else at


def _dealt(text: np.ndarray, left: np.ndarray, at: np.ndarray, level: int, depth: int) -> Iterator[np.ndarray]:
    """Groups of positions, in order, that are small enough to be sorted in memory."""
    if len(at) <= BLOCK // 4 or level == depth:
        if len(at):
            yield at
        return
    ended = left[at] <= level
    if ended.any():
        yield at[ended]
    rest = at[~ended]
    letters = text[rest + level]
    for c in np.unique(letters):
        yield from _dealt(text, left, rest[letters == c], level + 1, depth)


def suffix_order(text: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Positions of all suffixes of the strings text[bounds[i]:bounds[i + 1]], by their first ``depth`` bytes.

    Suffixes end with their string, the end being smaller than any byte. Blocks come in falling order of their bytes,
    and positions inside a block too. Equal ones stand together.
    """
    bounds = np.unique(bounds)
    n = len(text)
    if not n:
        return
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    small = _types(text, bounds[1:] - 1)
    lms = small & ~first
    lms[1:] &= ~small[:-1]
    at = _by_bytes(text, left, np.flatnonzero(lms).astype(np.int64), depth)
    seeds: list[Queue] = [Queue() for _ in range(256)]
    large: list[Queue] = [Queue() for _ in range(256)]
    rising: list[Queue] = [Queue() for _ in range(256)]  # what ``large`` gave out, for the way back

    def deal(block: np.ndarray, to: list[Queue]) -> None:
        letters = text[block]
        order = np.argsort(letters, kind="stable")
        cuts = np.flatnonzero(np.diff(letters[order])) + 1
        for part in np.split(block[order], cuts):
            if len(part):
                to[text[part[0]]].put(part)

    def before(block: np.ndarray) -> np.ndarray:
        return block[~first[block]] - 1

    deal(at, seeds)
    deal(bounds[1:].astype(np.int64) - 1, large)  # the strings' ends are the least suffixes; what is before them is L-type
    for c in range(256):
        for block in large[c].take():
            rising[c].put(block)
            behind = before(block)
            deal(behind[~small[behind]], large)
        for block in seeds[c].take():
            deal(before(block), large)
    falling: list[Queue] = [Queue() for _ in range(256)]
    for c in range(255, -1, -1):
        for block in falling[c].take():
            behind = before(block)
            deal(behind[small[behind]], falling)
            yield block
        for block in rising[c].reversed():
            behind = before(block)
            deal(behind[small[behind]], falling)
            yield block


def equal_groups(text: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """(position, group) blocks of the suffixes that have ``depth`` bytes: equal groups share their first ``depth`` bytes.

    The common prefix of neighbours in the order decides, compared up to ``depth``.
    """
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(text))
    group, last = 0, None
    steps = np.arange(depth)
    for block in suffix_order(text, bounds, depth):
        whole = block[left[block] >= depth]
        for i in range(0, len(whole), BLOCK // 8):
            some = whole[i : i + BLOCK // 8]
            rows = text[some[:, None] + steps]
            differs = np.ones(len(some), bool)
            differs[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            if last is not None:
                differs[0] = bool((rows[0] != last).any())
            number = group + np.cumsum(differs)
            group, last = int(number[-1]), rows[-1].copy()
            yield np.stack([some, number], axis=1)

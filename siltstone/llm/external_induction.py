"""Suffix order and common prefixes of one shard by external induced sorting, the method that op7 is named after.

Types and substrings: a suffix is smaller (S) or larger (L) than the one behind it; the S suffixes behind an L one cut the
text into substrings, which are sorted and named; if names repeat, the string of names is sorted by the same method,
recursively. Two priority queues then induce all L suffixes from left to right and all S suffixes from right to left: an
entry is (byte, rank of the suffix that induces it, place), and the common prefix of two neighbours is one more than the
least common prefix between their inducers. Queues keep `limit` entries in memory and the others on disk, in sorted runs of
the task's own scratch folder (a lost executor's task starts anew), so a shard may be far larger than memory but for its
text and a few numbers a suffix, which are flat arrays.

op7 does not run on it: see the README for what an entry costs. It is kept with its test as the measured form.
"""

from __future__ import annotations

import heapq
import shutil
import struct
import tempfile
from collections.abc import Iterator

import numpy as np

_ENTRY = struct.Struct("<qqq")


class DiskQueue:
    """A queue of triples of numbers, least first; more than `limit` of them are spilled as a sorted run."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.runs, self.folder = limit, [], [], None

    def push(self, entry: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit + len(self.runs):
            heads, own = [e for e in self.heap if len(e) == 4], sorted(e for e in self.heap if len(e) == 3)
            if self.folder is None:
                self.folder = tempfile.mkdtemp(prefix="queue_")
            path = f"{self.folder}/{len(self.runs)}"
            with open(path, "wb") as f:
                f.writelines(_ENTRY.pack(*e) for e in own)
            run = self._read(path)
            self.runs.append(run)
            self.heap = [*heads, (*next(run), len(self.runs) - 1)]
            heapq.heapify(self.heap)

    def _read(self, path: str) -> Iterator[tuple[int, int, int]]:
        with open(path, "rb") as f:
            while block := f.read(_ENTRY.size * 4096):
                yield from _ENTRY.iter_unpack(block)

    def top(self) -> tuple | None:
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple[int, int, int]:
        e = heapq.heappop(self.heap)
        if len(e) == 4 and (more := next(self.runs[e[3]], None)) is not None:
            heapq.heappush(self.heap, (*more, e[3]))
        return e[:3]

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Minima:
    """Numbers that are appended, and the least of any range of them."""

    BLOCK = 256

    def __init__(self, n: int):
        self.x, self.b, self.n = np.zeros(n + 1, np.int64), np.full(n // self.BLOCK + 2, 1 << 62, np.int64), 0

    def append(self, v: int) -> None:
        self.x[self.n] = v
        k = self.n // self.BLOCK
        if v < self.b[k]:
            self.b[k] = v
        self.n += 1

    def least(self, a: int, b: int) -> int:
        """Of a..b - 1."""
        if b - a < 3 * self.BLOCK:
            return int(self.x[a:b].min())
        i, j = a // self.BLOCK + 1, b // self.BLOCK
        return int(min(self.x[a : i * self.BLOCK].min(), self.b[i:j].min(), self.x[j * self.BLOCK : b].min() if j * self.BLOCK < b else 1 << 62))


def _common(t: np.ndarray, a: int, b: int, known: int = 0) -> int:
    """Common prefix of two suffixes, by blocks of comparisons from `known` on."""
    n, size = len(t), 64
    while max(a, b) + known < n:
        m = min(size, n - max(a, b) - known)
        d = np.flatnonzero(t[a + known : a + known + m] != t[b + known : b + known + m])
        if len(d):
            return known + int(d[0])
        known, size = known + m, size * 4
    return known


def suffixes(text: np.ndarray, limit: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes in order, common prefix of each with the one before it) of numbers above zero."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    t = np.append(np.asarray(text, np.int64), 0)  # the least sign ends the text
    less = np.zeros(n + 1, bool)  # S
    less[n] = True
    change = np.flatnonzero(t[:-1] != t[1:])
    upper = change[np.searchsorted(change, np.arange(n))]
    less[:-1] = t[upper] < t[upper + 1]
    starts = np.flatnonzero(less[1:] & ~less[:-1]) + 1  # the end's own is the last
    ends = np.append(starts[1:] + 1, n + 1)
    run = upper + 1 - np.arange(n)  # how often the first sign repeats
    # substrings in order, those of one content with one name
    # (one that goes on where another ends has an L suffix there, so it is the lesser)
    most = int(t.max()) + 1
    cut = [(*t[a:e].tolist(), most) for a, e in zip(starts, ends)]
    order = sorted(range(len(starts)), key=cut.__getitem__)
    name = np.zeros(len(starts), np.int64)
    for r, (i, j) in enumerate(zip(order, order[1:])):
        name[j] = name[i] + (cut[i] != cut[j])
    if len(starts) and name.max() + 1 < len(starts):
        ranked, same = suffixes(name + 1, limit)
    else:
        ranked, same = np.argsort(name), np.zeros(len(starts), np.int64)
    cuts = starts[ranked]
    far = np.zeros(len(cuts), np.int64)
    for k in range(1, len(cuts)):  # names in common, then signs
        i, j = int(ranked[k - 1]), int(ranked[k])
        m = int(same[k])
        far[k] = _common(t, int(starts[i]), int(starts[j]), int(starts[j + m] - starts[j]) if j + m < len(starts) and i + m < len(starts) else 0)

    def induced(seeds: np.ndarray, near: np.ndarray, up: bool) -> tuple[list[int], list[int]]:
        """Suffixes of one type from seeds of the other, both in the direction's order, with their common prefixes."""
        sign = 1 if up else -1
        queue, seen, out, prefix = DiskQueue(limit), Minima(2 * n + 2), [], []
        at, last, last_rank, before, was_seed = 0, -1, -1, -1, False
        while at < len(seeds) or queue.heap:
            top = queue.top()
            seed = at < len(seeds) and (top is None or sign * int(t[seeds[at]]) < top[0])
            if seed:
                p = int(seeds[at])
                lcp = int(near[at]) if was_seed or last < 0 else None
                at += 1
            else:
                key, rank, p = queue.pop()
                lcp = None
                same_sign = last >= 0 and t[last] == t[p]
                value = 1 + seen.least(last_rank + 1, rank + 1) if same_sign else 0
                out.append(p)
                prefix.append(value)
                if not was_seed and same_sign:
                    lcp = value
                last, last_rank = p, rank
            if lcp is None:  # neighbours of different kinds
                lcp = min(int(run[before]), int(run[p])) if before >= 0 and before < n and p < n and t[before] == t[p] else 0
            seen.append(lcp)
            if p and less[p - 1] != up:
                queue.push((sign * int(t[p - 1]), seen.n - 1, p - 1))
            before, was_seed = p, seed
        queue.close()
        return out, prefix

    larger, gap = induced(cuts, far, True)
    # S suffixes are induced by L ones from the right: common prefixes belong to the pair, so they move by one
    back = np.array(larger[::-1], np.int64)
    smaller, gap2 = induced(back, np.append(0, np.array(gap[::-1], np.int64)[:-1]) if len(gap) else np.zeros(0, np.int64), False)
    smaller, gap2 = smaller[::-1], [0, *gap2[::-1][:-1]] if gap2 else []
    # by first sign, the larger ones first
    first = [(int(t[p]), 0, i, p, g) for i, (p, g) in enumerate(zip(larger, gap))] + [(int(t[p]), 1, i, p, g) for i, (p, g) in enumerate(zip(smaller, gap2)) if p < n]
    first.sort()
    places, prefixes = np.array([x[3] for x in first], np.int64), np.array([x[4] for x in first], np.int64)
    for k in range(1, len(first)):
        if first[k][0] != first[k - 1][0]:
            prefixes[k] = 0
        elif first[k][1] != first[k - 1][1]:
            prefixes[k] = min(int(run[places[k]]), int(run[places[k - 1]]))
    prefixes[:1] = 0
    return places, prefixes

"""Greedy string tiling with running Karp-Rabin hashes and falling match lengths.

The hash of any window follows from prefix sums of the words' numbers times the powers of an odd base modulo 2^64.  A round
looks up the longest length at which an unmarked window of one text still occurs in the other (by doubling and halving, as
a match of some length holds matches of all smaller ones), marks all matches of this length that do not overlap, and goes on
with smaller ones.  Rounds differ in length and every match marks its words, so a text of n words takes at most about
sqrt(2n) rounds of linear work, also where it repeats itself.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _spread(ids: np.ndarray) -> np.ndarray:
    """Word numbers as well mixed 64-bit values."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of the windows of a text at any length, and which of its words are marked."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(ids) * _powers(BASE, n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)
        self.marked = np.zeros(n, bool)
        self.marks = np.zeros(n + 1, np.int64)

    def free(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``width`` words without a marked one."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.nonzero(self.marks[width:] == self.marks[:n])[0]
        with np.errstate(over="ignore"):
            return at, (self.sums[at + width] - self.sums[at]) * self.back[at]

    def mark(self, at: int, width: int) -> None:
        self.marked[at : at + width] = True

    def settle(self) -> None:
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])


def _common(a: Windows, b: Windows, width: int) -> np.ndarray:
    return np.intersect1d(a.free(width)[1], b.free(width)[1])


def _longest(a: Windows, b: Windows, least: int, most: int) -> int:
    """The greatest length from ``least`` to ``most`` at which unmarked windows agree; below ``least`` if none do."""
    lo, hi, step = least - 1, most + 1, least
    while lo + 1 < hi:
        middle = min(hi - 1, lo + step) if step else (lo + hi) // 2
        if len(_common(a, b, middle)):
            lo, step = middle, step * 2
        else:
            hi, step = middle, 0
    return lo


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the longest unmarked matches of at least ``least`` words, longest first."""
    if least < 1 or not len(doc) or not len(item):
        return []
    a, b, out = Windows(doc), Windows(item), []
    width = min(len(doc), len(item))
    while width >= least:
        width = _longest(a, b, least, width)
        if width < least:
            break
        shared = _common(a, b, width)
        places: dict[int, list[int]] = {}
        at, h = b.free(width)
        keep = np.isin(h, shared)
        for q, x in zip(at[keep][::-1].tolist(), h[keep][::-1].tolist()):
            places.setdefault(x, []).append(q)
        at, h = a.free(width)
        keep, until = np.isin(h, shared), 0
        for p, x in zip(at[keep].tolist(), h[keep].tolist()):
            if p < until:
                continue
            row = places[x]
            while row and b.marked[row[-1] : row[-1] + width].any():
                row.pop()  # marked for good
            if row and np.array_equal(doc[p : p + width], item[row[-1] : row[-1] + width]):
                q = row.pop()
                a.mark(p, width)
                b.mark(q, width)
                out.append((p, q, width))
                until = p + width
        a.settle()
        b.settle()
        width -= 1
    return out


def chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The heaviest tiles that stand in the same order in both texts, in that order."""
    rows = sorted(found)
    best = [0] * len(rows)
    before = [-1] * len(rows)
    for i, (_, q, k) in enumerate(rows):
        best[i] = k
        for j in range(i):
            if rows[j][1] < q and best[j] + k > best[i]:
                best[i], before[i] = best[j] + k, j
    i, out = max(range(len(rows)), key=best.__getitem__, default=-1), []
    while i >= 0:
        out.append(rows[i])
        i = before[i]
    return out[::-1]

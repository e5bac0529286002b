"""Ratcliff-Obershelp similarity of many pairs of texts at once, in numpy.

Two texts match in their longest common run, and then on both sides of it. Of runs of one length the
first in the left text counts, and then the first in the right one. In a right text of at least
LONG characters, a character that is more than a hundredth of it begins no run, but may prolong one.

All open rectangles (a part of the left text against a part of the right one) of all pairs are
searched together: row by row of their tables of run lengths, as wide arrays. Those that have a run
leave up to two smaller ones for the next round.
"""

from __future__ import annotations

import numpy as np

LONG = 200
#: Cells of a row that are worked on at once, over all rectangles of a group.
CELLS = 1_000_000
_NO_LEFT, _NO_RIGHT = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


class _Texts:
    """Code points of texts, one after the other; at[k] to at[k + 1] are those of text k."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _unpopular(right: _Texts) -> np.ndarray:
    """Codes of the right texts, without those that may not begin a run."""
    codes = right.codes.copy()
    for k in np.flatnonzero(np.diff(right.at) >= LONG):
        own = codes[right.at[k] : right.at[k + 1]]
        values, place, counts = np.unique(own, return_inverse=True, return_counts=True)
        own[(counts > len(own) // 100 + 1)[place]] = _NO_RIGHT
    return codes


def _cut(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, fill: np.uint32) -> np.ndarray:
    """Rows of codes from begin on, filled up to the longest size."""
    place = np.arange(int(size.max()))
    inside = place < size[:, None]
    return np.where(inside, codes[np.minimum(begin[:, None] + place, len(codes) - 1)], fill)


def _longest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in left, begin in right, length) of the longest run of each row's pair, or zeros."""
    n, width = right.shape
    runs, before = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    best, at_left, at_right = (np.zeros(n, np.int64) for _ in range(3))
    for i in range(left.shape[1]):
        np.add(before[:, :-1], 1, out=runs[:, 1:])
        runs[:, 1:] *= right == left[:, i : i + 1]
        longest = runs.max(axis=1)
        better = np.flatnonzero(longest > best)
        if len(better):
            best[better] = longest[better]
            at_left[better] = i + 1 - longest[better]
            at_right[better] = runs[better].argmax(axis=1) - longest[better]
        runs, before = before, runs
    return at_left, at_right, best


def _prolonged(left: _Texts, right: _Texts, box: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray):
    """Runs made longer by all equal characters around them, inside of their rectangles."""
    a0, a1, b0, b1 = box.T
    for step in (-1, 1):
        live = np.arange(len(n))
        while len(live):
            x, y = (i[live] - 1, j[live] - 1) if step < 0 else (i[live] + n[live], j[live] + n[live])
            inside = (x >= a0[live]) & (y >= b0[live]) & (x < a1[live]) & (y < b1[live])
            live, x, y = live[inside], x[inside], y[inside]
            same = left.codes[x] == right.codes[y]
            live = live[same]
            n[live] += 1
            if step < 0:
                i[live] -= 1
                j[live] -= 1
    return i, j, n


def matches(a: list[str], b: list[str]) -> np.ndarray:
    """How many characters of each pair match."""
    left, right = _Texts(a), _Texts(b)
    begins = _unpopular(right)
    out = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    box = np.stack([left.at[:-1], left.at[1:], right.at[:-1], right.at[1:]], axis=1)
    while True:
        high, wide = box[:, 1] - box[:, 0], box[:, 3] - box[:, 2]
        some = np.flatnonzero((high > 0) & (wide > 0))
        if not len(some):
            return out
        some = some[np.lexsort((wide[some], high[some]))]
        pair, box, high, wide = pair[some], box[some], high[some], wide[some]
        next_pair, next_box, k = [], [], 0
        while k < len(some):
            # A group is as many rectangles of like height as fit.
            end = k + max(1, min(len(some) - k, CELLS // int(wide[k : k + 4096].max())))
            end = k + max(1, int(np.searchsorted(high[k:end], 2 * high[k] + 16, side="right")))
            part = box[k:end]
            rows = _cut(left.codes, part[:, 0], high[k:end], _NO_LEFT), _cut(begins, part[:, 2], wide[k:end], _NO_RIGHT)
            i, j, n = _longest(*rows)
            i, j, n = _prolonged(left, right, part, i + part[:, 0], j + part[:, 2], n)
            np.add.at(out, pair[k:end], n)
            found = np.flatnonzero(n)
            a0, a1, b0, b1 = part[found].T
            i, j, n = i[found], j[found], n[found]
            next_pair += [pair[k:end][found]] * 2
            next_box += [np.stack([a0, i, b0, j], axis=1), np.stack([i + n, a1, j + n, b1], axis=1)]
            k = end
        pair, box = np.concatenate(next_pair), np.concatenate(next_box)


def ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """2 * matching characters / all characters of each pair: 1 for equal texts, nan where one is null."""
    out = np.full(len(a), np.nan)
    open_pairs = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None:
            if x == y:
                out[k] = 1.0
            else:
                open_pairs.append(k)
    if open_pairs:
        x, y = [a[k] for k in open_pairs], [b[k] for k in open_pairs]
        sizes = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
        out[open_pairs] = 2.0 * matches(x, y) / sizes
    return out

"""Texts of an Arrow batch as one byte array, with words, lines and hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.Generator(np.random.PCG64(20250101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNDO)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of at most `limit` bytes, or of one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, end
        begin = end


class Flat:
    """data: all bytes; at[k] to at[k + 1]: those of text k. Nulls are empty texts."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
        self.at, self.n = ends - ends[0], len(texts)
        if lower:
            self.data = _LOWER[self.data]
        self._prefix: np.ndarray | None = None

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the mask."""
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def runs(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, text) of the runs of bytes outside the mask; no run crosses texts."""
        inside = ~breaks
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= breaks[:-1]
        closes[:-1] &= breaks[1:]
        edges = self.at[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return begin, end, np.searchsorted(self.at, begin, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(_SPACE[self.data])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans, equal for equal bytes wherever they stand."""
        up, down = powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[self.data] * up[:-1], dtype=np.uint64)])
        return mixed((self._prefix[end] - self._prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(3) + hashes[first + k])
    return out, first

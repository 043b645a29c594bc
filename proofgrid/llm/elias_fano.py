"""Elias-Fano sequences of non-decreasing numbers, built and queried with numpy on memory-mapped arrays.

A number's low bits lie packed side by side; its high part is a one in a bit vector, at (high part + index). Counts of ones and
zeros before each 64-bit word make both kinds of selection a binary search.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _bits(positions: np.ndarray, length: int) -> np.ndarray:
    words = np.zeros((length >> 6) + 2, U)
    np.bitwise_or.at(words, positions >> 6, U(1) << (positions & 63).astype(U))
    return words


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The sections of a sequence of values below `universe`."""
    values, n = values.astype(U), len(values)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    ones = (values >> U(low)).astype(np.int64) + np.arange(n)
    length = n + (max(universe, 1) >> low) + 2
    high = _bits(ones, length)
    packed = np.zeros((n * low >> 6) + 2, U)
    if low and n:
        rest, at = values & U((1 << low) - 1), np.arange(n, dtype=np.int64) * low
        shift = (at & 63).astype(U)
        np.bitwise_or.at(packed, at >> 6, rest << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(packed, (at[over] >> 6) + 1, rest[over] >> (U(64) - shift[over]))
    before = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
    kind = np.uint32 if length < 1 << 32 else np.int64
    return {
        "head": np.array([n, low, length], np.int64),
        "low": packed,
        "high": high,
        "ones": before.astype(kind),
        "zeros": (64 * np.arange(len(high), dtype=np.int64) - before).astype(kind),
    }


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
    """The position of the one (zero, if `flip`) with each rank; `before` counts them before each word."""
    word = np.searchsorted(before, rank.astype(before.dtype), side="right") - 1
    left = (rank - before[word].astype(np.int64)).astype(np.uint8)  # below 64, as are the bits
    here = ~words[word] if flip else words[word]
    bit = np.zeros(len(rank), np.uint8)
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(here & U((1 << width) - 1))
        up = left >= count
        left -= count * up
        step = up * np.uint8(width)
        bit += step
        here >>= step.astype(U)
    return (word << 6) + bit


def _next(words: np.ndarray, before: np.ndarray, position: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
    """The position of the one (zero, if `flip`) that follows the one of each rank, which is at `position`."""
    word = position >> 6
    rest = (~words[word] if flip else words[word]) >> (position & 63).astype(U) >> U(1)
    out = position + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1))
    far = np.flatnonzero(rest == 0)  # in a later word
    out[far] = _select(words, before, rank[far] + 1, flip)
    return out


class Sequence:
    """Queries on the sections that `build` made."""

    def __init__(self, sections: dict[str, np.ndarray]):
        self.n, self.low_bits, _ = (int(x) for x in sections["head"])
        self.low, self.high, self.ones, self.zeros = (sections[k] for k in ("low", "high", "ones", "zeros"))

    def _rest(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        over = (self.low[word + 1] << U(1)) << (U(63) - shift)
        return ((self.low[word] >> shift) | over) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at some indices."""
        i = np.asarray(i, np.int64)
        top = (_select(self.high, self.ones, i, False) - i).astype(U)
        return (top << U(self.low_bits)) | self._rest(i)

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at some indices and at the indices after them; an index that repeats its neighbour is looked up once."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, U), np.zeros(0, U)
        runs = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        times, i = np.diff(np.append(runs, len(i))), i[runs]
        one = _select(self.high, self.ones, i, False)
        following = _next(self.high, self.ones, one, i, False)
        found = [(top.astype(U) << U(self.low_bits)) | self._rest(k) for top, k in ((one - i, i), (following - i - 1, i + 1))]
        return np.repeat(found[0], times), np.repeat(found[1], times)

    def find(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The index in [first, last) of each value, -1 where there is none: the successor by high part, then low bits."""
        value = value.astype(U)
        top = (value >> U(self.low_bits)).astype(np.int64)
        below = np.maximum(top - 1, 0)
        zero = _select(self.high, self.zeros, below, True)
        a = np.where(top > 0, zero - below, 0)
        b = np.where(top > 0, _next(self.high, self.zeros, zero, below, True), zero) - top
        a, b = np.maximum(a, first), np.minimum(b, last)
        end, want = b.copy(), value & U((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            less = self._rest(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        out = np.full(len(value), -1, np.int64)
        inside = np.flatnonzero(a < end)
        hit = self._rest(a[inside]) == want[inside]
        out[inside[hit]] = a[inside[hit]]
        return out

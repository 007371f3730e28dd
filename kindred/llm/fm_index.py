"""FM-index over token sequences: BWT in a bit-packed wavelet matrix.

All queries are vectorised: one call moves many searches on by one token.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; zeros are separators, each smaller than the next one."""
    n = len(text)
    is_end = text == 0
    ends = int(is_end.sum())
    rank = np.where(is_end, np.cumsum(is_end) - 1, text.astype(np.int64) + ends)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (int(rank.max()) + n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Occurrences of a symbol before a position, from packed bits per level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self._bits, self._before, self._zeros = [], [], []
        n = len(symbols)
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros((n >> 6 << 3) + 8, np.uint8)
            padded[: len(packed)] = packed
            words = padded.view(np.uint64)
            self._bits.append(words)
            self._before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32))
            self._zeros.append(n - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of ``symbol`` lies on the last level."""
        one = np.uint64(1)
        for k in range(self.levels):
            word = at >> 6
            inside = self._bits[k][word] & ((one << (at & 63).astype(np.uint64)) - one)
            ones = self._before[k][word] + np.bitwise_count(inside)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self._zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over ``text``: tokens from 1 up, zeros between passages."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        sigma = int(text.max()) + 1 if len(text) else 1
        self.size = len(text)
        self._wavelet = WaveletMatrix(text[order - 1].astype(np.int64), max(1, sigma.bit_length()))
        self._smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        symbols = np.arange(sigma)
        self._shift = self._smaller - self._wavelet.place(symbols, np.zeros(sigma, np.int64))

    def extend(self, token: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of ``token`` + pattern, from the interval of the pattern."""
        both = self._wavelet.place(np.concatenate((token, token)), np.concatenate((low, high)))
        both += np.concatenate((self._shift[token],) * 2)
        return both[: len(token)], both[len(token) :]


def leftmost_repeats(index: FMIndex, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each ``text[start:end]``: the smallest ``i >= start`` so that
    ``text[i:end]`` occurs at least twice in the index.

    The searches run side by side; each ends at its start or when fewer than
    two occurrences are left.
    """
    at = end.copy()
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.size, np.int64)
    open_ = np.flatnonzero(at > start)
    while len(open_):
        new_low, new_high = index.extend(text[at[open_] - 1], low[open_], high[open_])
        goes = new_high - new_low >= 2
        open_ = open_[goes]
        low[open_], high[open_] = new_low[goes], new_high[goes]
        at[open_] -= 1
        open_ = open_[at[open_] > start[open_]]
    return at


def repeated_windows(index: FMIndex, text: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Flags of the positions of ``text`` at which a repeated window starts.

    ``first`` and ``last`` bound the window starts of each streamed passage.
    If a window fails, because ``text[f:end]`` is no repeat, no start up to f
    can succeed and the search goes on at f + 1.  After a hit the longest
    repeat from that start is bisected: it proves all its windows at once.
    """
    hit = np.zeros(len(text) + 1, np.int32)
    start, known = first.copy(), np.full(len(first), -1, np.int64)
    top = last - start + 1  # so many windows from the start on are not all proved
    open_ = np.flatnonzero(top > 0)
    while len(open_):
        s, k, t = start[open_], known[open_], top[open_]
        whole = t == last[open_] - s + 1
        more = np.where(k < 0, 0, np.where(whole, t - 1, (k + t) // 2))
        left = leftmost_repeats(index, text, s, s + more + window)
        good = left == s
        missed = ~good & (k < 0)
        k = np.where(good, more, k)
        t = np.where(good | missed, t, more)
        done = (k >= 0) & (k + 1 >= t)
        np.add.at(hit, s[done], 1)
        np.add.at(hit, (s + k + 1)[done], -1)
        s = np.where(done, s + k + 1, np.where(missed, left, s))
        fresh = done | missed
        start[open_] = s
        known[open_] = np.where(fresh, -1, k)
        top[open_] = np.where(fresh, last[open_] - s + 1, t)
        open_ = open_[start[open_] <= last[open_]]
    return np.cumsum(hit[:-1]) > 0

"""A compressed FM-index over word ids: wavelet matrix, ranks and backward search."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence; one packed bit row per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        n = len(symbols)
        self.rows, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            ones = ((now >> b) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = ones
            row = np.packbits(padded, bitorder="little").view("<u8")
            self.rows.append(row)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(row), dtype=np.int64)])[:-1])
            self.zeros.append(int(n - ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])
        self.begin = np.zeros(sigma + 1, np.int64)
        uniq, first = np.unique(now, return_index=True)
        self.begin[uniq] = first

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k, (row, counts, zeros) in enumerate(zip(self.rows, self.counts, self.zeros, strict=True)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(row[word] & below)
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at - self.begin[symbols]


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the next ``depth`` or more symbols, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    done = 1
    while True:
        nxt = np.zeros(n, np.int64)
        if done < n:
            nxt[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        done *= 2
        new = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if done >= depth or new[-1] == n - 1:
            return order


class FMIndex:
    """Weighted occurrences of patterns of up to ``depth`` symbols; symbol 0 separates and is never searched."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, depth: int) -> None:
        order = suffix_order(ids, depth)
        sigma = int(ids.max()) + 1
        self.wavelet = WaveletMatrix(ids[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=sigma))])
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        self.size = len(ids)

    def matched(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """For each span of ``ids``, the length of its longest suffix that occurs with a weight of
        ``least`` or more: backward search from the right end, all spans in step."""
        length = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        at = ends.copy()
        while len(live):
            c = ids[at[live] - 1]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            ok = self.weight[hi] - self.weight[lo] >= least
            live, lo, hi = live[ok], lo[ok], hi[ok]
            at[live] -= 1
            length[live] += 1
            more = at[live] > starts[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return length

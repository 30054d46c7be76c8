"""Vectorised words of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for
UTF-8 equals ``[^\\x20\\x09-\\x0D]+`` over code points. Everything works on
blocks of whole texts: a block holds about ``BLOCK`` bytes, or one longer text,
so memory follows the longest text and not the batch. Null texts count as empty.

Words are known by 64-bit hashes: a polynomial over random byte codes modulo
2**64, then a finaliser. Two different words of one comparison agree with
probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a column; ``offsets`` start at 0."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @cached_property
    def _word(self) -> np.ndarray:
        return ~_SPACE[self.data]

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        word, size = self._word, len(self.data)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.empty(size + 1, bool)
        first[0] = first[size] = True
        first[1:size] = ~word[:-1]
        first[self.offsets[(self.offsets < size)]] = True
        starts = np.flatnonzero(word & first[:size])
        last = np.empty(size, bool)
        last[-1] = True
        last[:-1] = ~word[1:]
        last[self.offsets[(self.offsets > 0)] - 1] = True
        return starts, np.flatnonzero(word & last) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def ends(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def doc(self) -> np.ndarray:
        """For each word, its text's place in the block."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def first_word(self) -> np.ndarray:
        """For each text and one past, the place of its first word."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def _prefix(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_CODE[self.data] * _power(len(self.data))[0][: len(self.data)], out=out[1:])
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, equal for equal bytes wherever they stand."""
        back = _power(len(self.data) + 1)[1]
        return mix((self._prefix[ends] - self._prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEP)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Counts a flag per byte by text."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all k-word windows, and the windows' hashes."""
        left = self.first_word[1:][self.doc] - np.arange(len(self.doc))
        at = np.flatnonzero(left >= k)
        return at, window_hash(self.hashes, at, k)


def window_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    scale = 1
    for j in range(k):
        total += hashes[at + j] * _U(scale)
        scale = scale * _BASE % (1 << 64)
    return mix(total)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, so that reused workers don't keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """The whole column as blocks; ``lower`` maps A-Z only."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        part = data[offsets[lo] : offsets[hi]]
        yield Block(lo, hi, _LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    give_back()


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out

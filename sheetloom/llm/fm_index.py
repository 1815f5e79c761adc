"""An FM-index over a sequence of small integers: suffix order, wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order. The last symbol is 0 and occurs nowhere else. Prefix doubling, in which only suffixes that
    are still tied are sorted again."""
    n = len(text)
    h = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(min(h, n)):
        key[: n - j] |= text[j:].astype(np.int64) << (bits * (h - 1 - j))
    order = np.argsort(key)
    key = key[order]
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    lone = head & np.append(head[1:], True)
    tied = np.flatnonzero(~lone)
    while len(tied):
        at = order[tied]
        key = place[tied] * (n + 1) + rank[np.minimum(at + h, n - 1)]
        by = np.argsort(key)
        order[tied] = at[by]
        key = key[by]
        head = np.empty(len(tied), bool)
        head[0] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        place[tied] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        rank[order[tied]] = place[tied]
        tied = tied[~(head & np.append(head[1:], True))]
        h *= 2
    return order


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Symbol ranks in a sequence, by one bit vector for each bit of the alphabet."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(bits - 1, -1, -1):
            one = (text >> b & 1).astype(bool)
            zeros = text[~one]
            self.levels.append((b, Bits(one), len(zeros)))
            text = np.concatenate([zeros, text[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i entries."""
        low = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            ones_low, ones_i = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + ones_low, low - ones_low)
            i = np.where(one, zeros + ones_i, i - ones_i)
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one = bits.at(i)
            symbol |= one.astype(np.int64) << b
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        bits = max(1, int(n_symbols - 1).bit_length())
        order = suffix_order(text, bits)
        self.n = len(text)
        self.first = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.first[1:])
        self.last = Wavelet(text[order - 1], bits)
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order whose suffixes start with each row of `patterns` (its first `lengths` symbols)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            go = np.flatnonzero((step < lengths) & (low < high))
            if not len(go):
                break
            c = patterns[go, lengths[go] - 1 - step].astype(np.int64)
            ranks = self.last.rank(np.concatenate([c, c]), np.concatenate([low[go], high[go]]))
            low[go] = self.first[c] + ranks[: len(go)]
            high[go] = self.first[c] + ranks[len(go) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of entries of the suffix order: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled.at(rows)
            out[left[done]] = self.samples[self.sampled.rank(rows[done])] + steps
            left, rows = left[~done], rows[~done]
            c = self.last.at(rows)
            rows = self.first[c] + self.last.rank(c, rows)
            steps += 1
        return out

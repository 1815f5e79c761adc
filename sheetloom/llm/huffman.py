"""Canonical length-limited Huffman codes over numpy arrays: code lengths, packing and table-driven unpacking."""

from __future__ import annotations

import numpy as np

LONGEST = 20
#: Ids between two bit offsets from which decoding can begin.
STRIDE = 1024


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code by package-merge; 0 where a symbol's count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    by = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[by].astype(np.float64)
    row, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([leaves, row[0:even:2] + row[1:even:2]])
        order = np.argsort(both, kind="stable")
        row = both[order]
        is_leaf.append(order < n)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        k = int(np.count_nonzero(leaf[:take]))
        out[by[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = before = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[s])
        if bits:
            code <<= bits - before
            codes[s], before = code, bits
            code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of `ids`, first bit first, and the bit at which each STRIDE-th begins."""
    bits = lengths[ids]
    at = np.cumsum(bits) - bits
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    out = np.zeros(int(word[-1]) + 2 if len(ids) else 0, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] += np.add.reduceat(value >> np.uint64(32), heads)
        out[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    return out.astype(">u4").tobytes(), at[::STRIDE]


class Table:
    """For each possible run of the longest code's bits, the symbol that it begins with and that symbol's bits."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=0)))
        codes = canonical(lengths)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.bits = np.zeros(1 << self.width, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.width - lengths[used])
        if len(used):
            first = int(codes[used[0]]) << (self.width - int(lengths[used[0]]))
            self.symbol[first : first + spans.sum()] = np.repeat(used, spans)
            self.bits[first : first + spans.sum()] = np.repeat(lengths[used], spans)

    def unpack(self, data: list[bytes], offsets: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of each run of bytes. All stretches between bit offsets are decoded side by side."""
        raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8).astype(np.uint32)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        base = np.cumsum([0, *map(len, data)])[:-1]
        at = np.concatenate([o + 8 * b for o, b in zip(offsets, base, strict=True)])
        left = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(o))) for o, n in zip(offsets, counts, strict=True)])
        out = np.zeros((STRIDE, len(at)), np.uint32)
        most, shift = len(four) - 1, np.uint32(32 - self.width)
        for k in range(int(left.max(initial=0))):
            window = (four[np.minimum(at >> 3, most)] << (at & 7).astype(np.uint32)) >> shift
            out[k] = self.symbol[window]
            at += self.bits[window]
        flat = out.T.ravel()[(np.arange(STRIDE) < left[:, None]).ravel()]
        return np.split(flat, np.cumsum(counts)[:-1])

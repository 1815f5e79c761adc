"""Whole texts as UTF-8 bytes in numpy: word boundaries and 64-bit word hashes for a block of texts at a time.

A hash takes a run of bytes eight at a time through a keyed bijection of 64-bit integers that is not linear, so it is one
to one for the runs of up to eight bytes of each length; runs of more than LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
LONG = 64
_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 1 + LONG // 8, dtype=np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: After lower-casing: digits, a-z and every byte of a character beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
NON_SPACE = ~((_codes == 0x20) | ((_codes >= 9) & (_codes <= 13)))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as rows; beyond the end they are zero."""
    return np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes."""
    size, eight = ends - starts, lanes(data)
    out = mix(size.astype(np.uint64) + _KEYS[0])
    live, step = np.flatnonzero(size <= LONG), 0
    while len(live):
        lane = eight[starts[live] + 8 * step].view("<u8")[:, 0]
        lane &= _MASK[np.minimum(size[live] - 8 * step, 8)]
        out[live] = mix((out[live] ^ lane) + _KEYS[step])
        step += 1
        live = live[size[live] > 8 * step]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of the run whose number stands in `other`."""
    size, eight = ends - starts, lanes(data)
    same = size == size[other]
    live, step = np.flatnonzero(same & (other != np.arange(len(other)))), 0
    while len(live):
        mask = _MASK[np.minimum(size[live] - 8 * step, 8)]
        a, b = (eight[starts[k] + 8 * step].view("<u8")[:, 0] & mask for k in (live, other[live]))
        same[live[a != b]] = False
        step += 1
        live = live[(a == b) & (size[live] > 8 * step)]
    return same


@dataclass
class Block:
    """Texts as one run of bytes: text i is data[bounds[i]:bounds[i + 1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts, in blocks of about `most` bytes (one text at least); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    _, where, raw = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield Block(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def word_bounds(block: Block, data: np.ndarray, kind: np.ndarray, breaks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind, which no text's end lies in. breaks: also begin a word where a byte
    of the second kind follows one of the first."""
    n = len(data)
    inner = kind[data]
    joined = np.zeros(n + 1, bool)  # whether a byte belongs to the word of the one before it
    joined[1:n] = inner[1:] & inner[:-1]
    joined[block.bounds] = False
    if breaks:
        joined[1:n] &= ~(breaks[0][data[:-1]] & breaks[1][data[1:]])
    return np.flatnonzero(inner & ~joined[:n]), np.flatnonzero(inner & ~joined[1:]) + 1


def words(block: Block, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words as byte offsets, the first word of each text (with a last entry), and word hashes."""
    data = LOWER[block.data] if lower else block.data
    starts, ends = word_bounds(block, data, kind)
    return starts, ends, np.searchsorted(starts, block.bounds), run_hashes(data, starts, ends)

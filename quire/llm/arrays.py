"""Vectorised text helpers used inside Arrow tasks.

A block is a run of whole rows: its UTF-8 bytes in one ``uint8`` array plus
row offsets.  Words, lines and n-grams are spans of that array, hashed without
a Python loop.  Blocks hold a few megabytes (or one row that is larger), so
the temporaries stay small whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def byte_set(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_SPACE = byte_set(WHITESPACE)
IS_NOT_SPACE = ~IS_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row has no bytes."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows that hold at most ``limit`` bytes, or one larger row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, bytes, offsets from 0) of each block of a string column."""
    raw, offsets = text_buffers(column)
    for i, j in row_blocks(offsets, limit):
        yield i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row in which each byte position lies."""
    return np.searchsorted(offsets, positions, "right") - 1


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """(starts, ends, rows) of the maximal runs of member bytes inside rows."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, rows_of(offsets, starts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have[:n]


def power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd base and of its inverse, modulo 2**64: prefix
    sums over ``x * up`` give the rolling hash of any window."""
    return _power("up", _BASE, n), _power("down", _BASE_INVERSE, n)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data`` whose starts and ends both ascend;
    equal bytes give equal hashes wherever they stand.  Works in segments, so memory does
    not follow the length of ``data``."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(int(np.searchsorted(ends, low + SEGMENT_BYTES, "right")), i + 1)
        high = int(ends[j - 1])
        size = high - low
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[low:high]] * _power("up", _BASE, size), out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        h = (total[b] - total[a]) * _power("down", _BASE_INVERSE, size + 1)[a]
        out[i:j] = mix64(h + (b - a).astype(np.uint64))
        i = j
    return out


_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (len(words)-k+1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix64((h + words[i:i + n]) * _ODD[i % 5])
    return h


def segment_starts(rows: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if len(rows) == 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int):
    """(32-bit hashes, positions) of all byte n-grams that stay in one row and
    have no white space except at either end."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    good = np.ones(m, bool)
    space = IS_SPACE[data]
    for i in range(1, n - 1):
        good &= ~space[i:i + m]
    good &= ~(space[:m] & space[n - 1:n - 1 + m])
    for c in offsets[1:-1]:
        good[max(0, c - n + 1):c] = False
    at = np.flatnonzero(good)
    h = np.full(len(at), n, np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) + data[at + i]
    return mix32(h), at


def sorted_unique(keys: np.ndarray) -> np.ndarray:
    if len(keys) == 0:
        return keys
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]]

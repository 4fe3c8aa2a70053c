"""Text columns as byte buffers, and hashes of words and windows over them, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
GRAM_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random-looking word for each byte value, never 0.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * BASE)

#: Everything but space and the five ASCII controls from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; NULL is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row makes a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = max(low + 1, high)
        yield low, high
        low = high


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray):
    """Start and end byte of every word, and the first word of every row (plus the total)."""
    inside = word_byte[data]
    joined = np.zeros(len(data) + 1, bool)  # the byte continues the word before it
    joined[1:-1] = inside[1:] & inside[:-1]
    joined[offsets] = False
    start = np.flatnonzero(inside & ~joined[:-1])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    return start, end, np.searchsorted(start, offsets)


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse; kept for the next call."""
    if len(_POWERS[0]) < size:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:size], _POWERS[1][:size]


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever lies around it."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive codes, by doubling: two halves make a whole."""
    if size > len(codes):
        return np.empty(0, U64)
    if size == 1:
        return codes
    if size % 2:
        return windows(codes, size - 1)[:-1] * U64(GRAM_BASE) + codes[size - 1 :]
    half = windows(codes, size // 2)
    return half[: -(size // 2)] * _gram_power(size // 2) + half[size // 2 :]


@lru_cache(maxsize=None)
def _gram_power(size: int) -> np.uint64:
    return U64(pow(GRAM_BASE, size, 1 << 64))


def room(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` units that lie inside one row, and their number by row."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], count), count


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, by doubling."""
    reach, low = 1, values
    while reach * 2 <= size:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[: len(low) - (size - reach)], low[size - reach :]) if reach < size else low

"""Vectorised helpers over Arrow string columns: byte buffers, words, word hashes and shingles.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; with one longer text in a slice, its words are still hashed in blocks of so many.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a block of bytes: 4 MB, whatever the texts."""
    up, down = np.full(SLICE_BYTES, _BASE, np.uint64), np.full(SLICE_BYTES, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def runs(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte past the last) of each longest run of bytes with inside[byte], rows kept apart."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = inside[body]
    first = within.copy()
    first[1:] &= ~within[:-1]
    at_row = offsets[offsets < n]
    first[at_row] = within[at_row]
    last = within.copy()
    last[:-1] &= ~within[1:]
    before_row = offsets[1:][offsets[1:] > 0] - 1
    last[before_row] = within[before_row]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A-Z read as a-z; in blocks of ``SLICE_BYTES``, so that no text is too long."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    for at in range(0, len(body), SLICE_BYTES):
        part = body[at : at + SLICE_BYTES]
        to = at + len(part)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        if len(part) == len(body):
            return mix((sums[ends] - sums[starts]) * down[starts])
        within = np.flatnonzero((starts >= at) & (starts < to) & (ends <= to))
        out[within] += (sums[ends[within] - at] - sums[starts[within] - at]) * down[starts[within] - at]
        for i in np.flatnonzero((starts < to) & (ends > at) & ((starts < at) | (ends > to))):  # spans that lie across blocks
            a, b = max(int(starts[i]), at), min(int(ends[i]), to)
            piece = (int(sums[b - at]) - int(sums[a - at])) * int(down[a - at]) * pow(_BASE, a - int(starts[i]), 1 << 64)
            out[i] = np.uint64((int(out[i]) + piece) % (1 << 64))
    return mix(out)


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each row): row i has words counts[i]:counts[i + 1]."""
    starts, ends = runs(body, offsets, ~_SPACE)
    return span_hashes(body, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text; with fewer words the whole as one; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    return np.unique(out)

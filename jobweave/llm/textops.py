"""Vectorised scans over the bytes of Arrow string columns: words, word hashes, shingles.

A word is a maximal run of bytes other than the ASCII blanks 0x20 and 0x09 to 0x0D. Words get 64-bit hashes from one
prefix sum over the bytes, so no Python string is made per word. That hash is a polynomial modulo 2**64, which has known
collisions among long strings (Thue-Morse words); runs of more than LONG bytes therefore get a cryptographic one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
SLICE_BYTES = 1 << 20
LONG = 96

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, SLICE_BYTES).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            values = np.full(size, base, _U)
            values[0] = 1
            _powers[k] = np.multiply.accumulate(values)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: first row, last row + 1, bytes, offsets. Nulls are empty; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


@dataclass
class Words:
    """Words of several texts: byte ranges, hashes, and `bounds`, the index of each text's first word (and the total)."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    sums: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def prefix_hash(low: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash gives the hash of any byte range."""
    sums = np.zeros(len(low) + 1, _U)
    np.cumsum(BYTE_VALUE[low] * powers(len(low))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes give equal hashes wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(_U) * ODD[63])


def content_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of any length: range_hash up to LONG bytes, BLAKE2 beyond."""
    out = range_hash(sums, start, stop)
    for k in np.flatnonzero(stop - start > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = BLANK) -> Words:
    """Words of the texts that `offsets` cut from `data`; `blank` marks the bytes that part them."""
    low = LOWER[data] if lower else data
    n = len(low)
    if not n:
        return Words(*[np.zeros(0, np.int64)] * 2, np.zeros(0, _U), np.zeros(len(offsets), np.int64), low, np.zeros(1, _U))
    word = ~blank[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = edge[:n].copy(), edge[1:].copy()
    first[1:] |= ~word[:-1]
    last[:-1] |= ~word[1:]
    start = np.flatnonzero(word & first)
    stop = np.flatnonzero(word & last) + 1
    sums = prefix_hash(low)
    return Words(start, stop, content_hash(low, sums, start, stop), np.searchsorted(start, offsets), low, sums)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and each text's bounds.

    A text of fewer than `width` words has its whole word sequence as its one shingle; a text without words has none.
    """
    h, bounds = words.hash, words.bounds
    counts = np.diff(bounds)
    n = len(h)
    if n >= width:
        rolled = h[: n - width + 1] * ODD[0]
        for j in range(1, width):
            rolled += h[j : n - width + 1 + j] * ODD[j]
        ends = np.repeat(bounds[1:], counts)[: n - width + 1]
        whole = np.arange(n - width + 1) + width <= ends
        values, owners = mix(rolled[whole]), np.repeat(np.arange(len(counts)), counts)[: n - width + 1][whole]
    else:
        values, owners = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([int((h[bounds[t] : bounds[t + 1]] * ODD[: counts[t]]).sum(dtype=_U)) for t in short], _U)
        own = mix(own + counts[short].astype(_U) * ODD[62])
        where = np.searchsorted(owners, short)
        values, owners = np.insert(values, where, own), np.insert(owners, where, short)
    edges = np.searchsorted(owners, np.arange(len(counts) + 1))
    for t in np.flatnonzero(np.diff(edges) > 1):
        values[edges[t] : edges[t + 1]].sort()
    keep = np.ones(len(values), bool)
    if len(values):
        keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[keep], np.searchsorted(owners[keep], np.arange(len(counts) + 1))

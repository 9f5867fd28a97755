"""Flat numpy views of Arrow text batches: words, range hashes, chunks.

Every text operator of this subpackage reads a batch of texts as one byte
buffer plus document offsets, and computes on whole arrays.  Chunks are bounded
by bytes (a longer document is a chunk of its own), so memory follows
``CHUNK_BYTES`` and the longest document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Odd multipliers: invertible modulo 2**64, so a range hash needs one prefix sum.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) + (n >> 1)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        if size > 1 << 23:  # a giant document: do not keep its tables
            return out[0], out[1]
        _POWERS[which] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer: spreads the high bits over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Weighted prefix sums of ``values`` (uint64) for ``range_hash``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(which, len(values) + 1)[0][:len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the ranges [lo, hi) of the values behind ``sums``."""
    return mix((sums[hi] - sums[lo]) * _powers(which, len(sums))[1][lo])


def byte_values(buf: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLES[which][buf]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes inside each document: (starts, ends, first
    run of each document); documents are never joined."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = mask[at]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = mask[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` as (starts, ends, first word of each document)."""
    return runs(~SPACE[buf], offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hash(prefix(byte_values(buf, which), which), starts, ends, which)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions inside any [lo, hi)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0


def owner(offsets: np.ndarray) -> np.ndarray:
    """Document number of every element of a flat array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

"""Small numpy helpers over Arrow text columns, used inside Spark tasks.

A batch of texts is one byte buffer plus offsets; work is done on slices of bounded bytes, so memory follows the
slice and the longest single text, never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 1 << 20
SHORT_SLICE = 1 << 18  # where a byte takes many words of work space


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, stream: int) -> np.ndarray:
    """n fixed pseudo-random words; the same on every executor."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(stream) * U64(1 << 32)) * _STEP)


_BYTE = seeds(256, 7)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))
_BASE = int(seeds(1, 11)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SHORT_SLICE + 1 if len(_powers[0]) == 1 else 2 * len(_powers[0]))
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = (tables[0], tables[1])
    return _powers


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def release() -> None:
    """Gives freed memory back to the system, so that a worker kept for later tasks does not hold on to its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    release()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, from one running polynomial sum."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        raw = (total[end] - total[start]) * down[start]
        return mix64(raw + (end - start).astype(U64) * _STEP)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+length[0]-1, start[1].. and so on, as one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep].astype(np.int64), length[keep].astype(np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total, dtype=np.int64)

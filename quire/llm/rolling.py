"""Vectorised hashing of whole texts inside a task.

Every function works on one Arrow batch (or a slice of it): the UTF-8 bytes of all
texts in one ``uint8`` buffer plus the offsets of the texts.  Substring hashes are
polynomials over 2**64 read from prefix sums, so any window of any length costs one
subtraction and one product.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; temporary arrays hold about 100 bytes for each.
SLICE_BYTES = 1 << 18
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, U), np.ones(1, U)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n + 1, 1 << 16), b, U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[0] = 0 of the symbols times the powers of the base."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols))[0][:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end), equal for equal content and length."""
    inv = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U))


def return_freed_memory() -> None:
    """Gives freed memory back to the system, where the C library can; Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of rows of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, offsets); null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    return_freed_memory()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and the index of each text's first word.

    Words are runs without the bytes 0x20 and 0x09-0x0D; none crosses two texts.
    """
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sampled_owners(order: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """For each start in ``valid``: the place of the least of ``order[start:start+width]``.

    Equal windows choose the same place in themselves, so these places are anchors that
    two equal windows always share.  Ties go to the leftmost.
    """
    bits = U(max(1, int(len(order)).bit_length()))
    low = (order >> bits << bits) | np.arange(len(order), dtype=U)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low[valid] & ((U(1) << bits) - U(1))).astype(np.int64)

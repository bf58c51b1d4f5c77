"""Text as flat numpy arrays: the columnar helpers of the operators that run on Arrow batches.

Every helper works on slices of a bounded number of bytes, so that its temporary arrays stay small
whatever the batch holds; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes that part words: tab, line feed, vertical tab, form feed, carriage return, blank.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int) -> np.ndarray:
    """Odd 64-bit multipliers for positions 0 to n-1."""
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_WEIGHTS = weights(4096)


def position_weights(n: int) -> np.ndarray:
    global _WEIGHTS
    if n > len(_WEIGHTS):
        _WEIGHTS = weights(2 * n)
    return _WEIGHTS


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of length rows + 1) of a string array without nulls; no copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): rows in order, each slice of about ``most`` bytes or one row."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(solid: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``solid``; no run crosses an offset of ``cuts``."""
    n = len(solid)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[cuts[cuts < n]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(solid & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data`` (bytes or code points): a sum weighted by position, finalised."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    w = position_weights(int(size.max()))
    begin = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
    terms = (data[pos + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * w[pos]
    return mix64(np.add.reduceat(terms, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the words of each row); words are runs of non-blank bytes, A-Z lower-cased."""
    starts, ends = spans(~SPACE[data], offsets)
    at = np.searchsorted(starts, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), at


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of one text; of the whole text if it has fewer words; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(n, k)
    w = weights(k + 1)
    total = np.full(n - width + 1, width, np.uint64) * w[k]
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * w[j]
    return mix64(total)


def split_rows(values: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(len(at) - 1):
        yield values[at[i] : at[i + 1]]

"""Words and hashes of many texts at once, over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, but for single texts that are longer.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + (1 << 16))
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

#: 9-13 and 32 separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and offsets of runs of rows of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n, row + 65536)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that do not cross a row."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = inside[head], inside[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, the same wherever the run stands."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_ranges(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, where its runs begin in ``starts``, and the end after the last."""
    return np.searchsorted(starts, offsets, "left")


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (and the end)."""
    if lower:
        data = LOWER[data]
    starts, ends = runs(~IS_SPACE[data], offsets)
    return run_hashes(data, starts, ends), row_ranges(starts, offsets)


_COEFFICIENTS = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words that follow each other, over the whole sequence."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n] * _COEFFICIENTS[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _COEFFICIENTS[j]
    return mix64(total + np.uint64(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, of all of them as one."""
    hashes, first = words(data, offsets)
    all_grams = grams(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            found = np.sort(all_grams[a : b - k + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            yield grams(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)


def rolling(values: np.ndarray) -> np.ndarray:
    """Sums from which ``windows_of`` gives the hash of any window of a sequence of numbers."""
    up, _ = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return sums


def windows_of(sums: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n numbers that begin at the places."""
    _, down = _POWERS.upto(len(sums))
    return mix64((sums[places + n] - sums[places]) * down[places])

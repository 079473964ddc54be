"""Vectorised text access over Arrow batches: no Python object for each word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes that one vectorised step handles, but for a single longer text.
BLOCK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most BLOCK_BYTES or one row."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-gap bytes within each row, and the index of each row's first run."""
    word = ~is_gap
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[i] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """What span_hashes needs of all bytes, for several calls over the same ones."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z taken as a-z unless the table says otherwise."""
    _, down = _power(len(data) + 1)
    sums = prefix_sums(data, table) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def exact_table() -> np.ndarray:
    """A byte table that tells upper from lower case."""
    table = _BYTE.copy()
    table[65:91] = mix(np.arange(65, 91, dtype=np.uint64)) | np.uint64(1)
    return table


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k consecutive values; empty if there are fewer."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _SHINGLE[i]
    return mix(total)


def short_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence shorter than a shingle."""
    total = (words * _SHINGLE[: len(words)]).sum(dtype=np.uint64, keepdims=True)
    return mix(total + np.full(1, len(words), np.uint64) * _MULT)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its k-word shingles (words: runs of non-space bytes, A-Z as a-z).

    A row with fewer words has its whole sequence as one; null, empty and blank rows have none.
    """
    for _, _, data, offsets in blocks(column):
        starts, ends, first = spans(SPACES[data], offsets)
        words = span_hashes(data, starts, ends)
        all_shingles = shingle_hashes(words, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(all_shingles[a : b - k + 1])
            elif b > a:
                yield short_hash(words[a:b])
            else:
                yield np.zeros(0, np.uint64)


def map_arrow(df, function: Callable, schema: str):
    """mapInArrow with only plain values in the closure."""
    return df.mapInArrow(function, schema)

"""Vectorised text kernels on Arrow buffers: word bounds, rolling and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Fixed odd multipliers of the hash functions below.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes 0x09-0x0D and 0x20 separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[9:14] = SPACE[32] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(MIX1)
    x ^= x >> U64(27)
    x *= U64(MIX2)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets) with at most `most` bytes each, or one longer row; null texts count as empty.

    Workers are used again by later tasks, so what a task has freed goes back to the system at its end."""
    try:
        for batch in batches:
            if batch.num_rows:
                yield from _slices(batch, column, most)
    finally:
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(f):
    """A generator over batches that gives freed memory back at its end, as text_slices does."""

    @wraps(f)
    def run(*args, **named):
        try:
            yield from f(*args, **named)
        finally:
            release()

    return run


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, len(col))
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of all words (maximal runs of bytes that are not in sep, within a document)."""
    inside = ~sep[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1][(offs[1:-1] < len(data)) & (offs[1:-1] > 0)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


#: Bytes of text whose words are hashed at once.
HASH_BLOCK = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each word (words in order); long texts are taken block by block."""
    if not len(starts):
        return np.zeros(0, U64)
    if len(data) <= HASH_BLOCK:
        return _word_hashes(data, starts, ends)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), HASH_BLOCK // 2)))
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
        if b > a:
            low = starts[a]
            out.append(_word_hashes(data[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low))
    return np.concatenate(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(BASE, len(data)), powers(BASE_INV, len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(MIX2))


def to_i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

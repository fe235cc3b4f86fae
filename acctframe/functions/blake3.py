"""BLAKE3, 32 bytes, of a column of byte strings; the chunks of all strings of a batch are compressed side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

U32 = np.uint32
#: Fixed values of the hash: initial words, the message schedule's permutation, rotations, sizes and flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], U32)
PERMUTED = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
ROTATIONS, ROUNDS, BLOCK, CHUNK = (16, 12, 8, 7), 7, 64, 1024
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: The columns and then the diagonals of the state that a round mixes.
MIXED = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U32(n)) | (x << U32(32 - n))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) after blocks (16, n)."""
    n = cv.shape[1]
    tail = np.stack([counter.astype(np.uint64) & 0xFFFFFFFF, counter.astype(np.uint64) >> 32, size, flags]).astype(U32)
    v = np.concatenate((cv, np.broadcast_to(IV[:4, None], (4, n)), tail))
    m = list(words)
    for _ in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(MIXED):
            for x, (r1, r2) in ((m[2 * k], ROTATIONS[:2]), (m[2 * k + 1], ROTATIONS[2:])):
                v[a] = v[a] + v[b] + x
                v[d] = _turn(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], r2)
        m = [m[p] for p in PERMUTED]
    return v[:8] ^ v[8:]


def digests(texts: list[bytes]) -> list[bytes]:
    """The hash of each string."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks = np.maximum(-(-sizes // CHUNK), 1)
    owner = np.repeat(np.arange(len(texts)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    left = np.minimum(sizes[owner] - number * CHUNK, CHUNK)
    data = np.frombuffer(b"".join(t.ljust(int(c) * CHUNK, b"\0") for t, c in zip(texts, chunks, strict=True)), "<u4").reshape(len(owner), CHUNK // BLOCK, 16)
    cv = np.tile(IV[:, None], (1, len(owner)))
    blocks = np.maximum(-(-left // BLOCK), 1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (b == 0) * CHUNK_START + last * CHUNK_END + (last & (chunks[owner[live]] == 1)) * ROOT
        cv[:, live] = compress(cv[:, live], data[live, b].T, number[live], np.minimum(left[live] - b * BLOCK, BLOCK), flags)
    while len(owner) > len(texts):
        # neighbours of one string are joined in pairs; one without a neighbour goes up as it is
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.bincount(owner)[owner]
        joins, keeps = np.flatnonzero((place % 2 == 0) & (place + 1 < count)), np.flatnonzero((place % 2 == 0) & (place + 1 == count))
        zero = np.zeros(len(joins), np.int64)
        made = compress(np.tile(IV[:, None], (1, len(joins))), np.concatenate((cv[:, joins], cv[:, joins + 1])), zero, zero + BLOCK, PARENT + (count[joins] == 2) * ROOT)
        stay = np.concatenate((joins, keeps))
        order = np.argsort(stay)
        cv, owner = np.concatenate((made, cv[:, keeps]), axis=1)[:, order], owner[stay][order]
    return [x.tobytes() for x in np.ascontiguousarray(cv.T.astype("<u4"))]


def _column(raw: pd.Series) -> pd.Series:
    some = raw[raw.notna()]
    return pd.Series(digests([bytes(b) for b in some]), index=some.index, dtype=object).reindex(raw.index).where(raw.notna(), None)


def blake3(raw):
    """BLAKE3 of a binary column as 32 bytes; null stays null."""
    return F.pandas_udf(_column, "binary")(raw)


def account_blake3(pubkey="pubkey", data="data"):
    """BLAKE3 of key and data."""
    return blake3(F.concat(F.col(pubkey), F.col(data)))

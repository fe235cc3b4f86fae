"""Codecs without a built-in: base58, places of records, Merkle proofs, cursors; and their Arrow UDFs."""

from __future__ import annotations

import base64
import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import functions as F

#: The base58 alphabet (a fixed value).
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
STORAGE = ("base", "delta", "compacted")


def base58_encode(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(ALPHABET[r])
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + "".join(reversed(out))


def base58_decode(text: str) -> bytes:
    n = 0
    for c in text:
        d = ALPHABET.find(c)
        if d < 0:
            raise ValueError(f"no base58 character: {c!r}")
        n = n * 58 + d
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _encode58(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else base58_encode(bytes(b)))


def _decode58(text: pd.Series) -> pd.Series:
    def decode(t):
        try:
            return None if t is None else base58_decode(t)
        except ValueError:
            return None

    return text.map(decode)


def to_base58(raw):
    return F.pandas_udf(_encode58, "string")(raw)


def from_base58(text):
    """null where the text is no base58."""
    return F.pandas_udf(_decode58, "binary")(text)


def decode_bytes(text: str, encoding: str = "hex") -> bytes:
    """Filter bytes as hex (with or without 0x), base58 or base64."""
    if encoding == "base58":
        return base58_decode(text)
    if encoding == "base64":
        return base64.b64decode(text, validate=True)
    return bytes.fromhex(text.removeprefix("0x"))


def encode_data(raw: bytes, encoding: str) -> str | bytes:
    if encoding == "base58":
        return base58_encode(raw)
    if encoding == "binary":
        return raw
    if encoding == "base64+zstd":
        import zstandard

        raw = zstandard.ZstdCompressor().compress(raw)
    return base64.b64encode(raw).decode()


#: file id, offset, stored size, data offset, data length, slot, write version, storage type (a fixed format).
_PLACE = struct.Struct("<QQIIIQQB")
_PLACE_FIELDS = ("file_id", "offset", "stored_size", "data_offset", "data_len", "slot", "write_version")


def pack_place(storage_type: str, **place: int) -> bytes:
    return _PLACE.pack(*(place[f] for f in _PLACE_FIELDS), STORAGE.index(storage_type))


def unpack_place(raw: bytes) -> dict:
    if len(raw) < _PLACE.size:
        raise ValueError(f"a place has {_PLACE.size} bytes, not {len(raw)}")
    *numbers, kind = _PLACE.unpack_from(raw)
    if kind >= len(STORAGE):
        raise ValueError(f"no storage type has number {kind}")
    return dict(zip(_PLACE_FIELDS, numbers, strict=True)) | {"storage_type": STORAGE[kind]}


def encode_cursor(**fields) -> str:
    return base64.b64encode(json.dumps(fields, sort_keys=True).encode()).decode()


def decode_cursor(text: str | None) -> dict | None:
    try:
        out = json.loads(base64.b64decode(text or "", validate=True))
        return out if isinstance(out, dict) else None
    except ValueError:
        return None


def node_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(left + right).digest()


def _level_up(level: list[bytes]) -> list[bytes]:
    pairs = [node_hash(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
    return pairs + level[len(level) - len(level) % 2 :]


def merkle_root(leaves: list[bytes]) -> bytes | None:
    """Root over leaf hashes in order; a node without a partner moves up unchanged."""
    while len(leaves) > 1:
        leaves = _level_up(leaves)
    return leaves[0] if leaves else None


def merkle_proof(leaves: list[bytes], index: int) -> list[tuple[bytes, bool]]:
    """(sibling, whether it is the left one) from the leaf up."""
    out = []
    while len(leaves) > 1:
        if index ^ 1 < len(leaves):
            out.append((leaves[index ^ 1], bool(index & 1)))
        leaves, index = _level_up(leaves), index // 2
    return out


def merkle_verify(leaf: bytes, proof: list[tuple[bytes, bool]], root: bytes) -> bool:
    for sibling, left in proof:
        leaf = node_hash(sibling, leaf) if left else node_hash(leaf, sibling)
    return leaf == root

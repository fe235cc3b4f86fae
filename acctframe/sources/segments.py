"""Delta segments: files of a header and of entries (slot, write version, key, data); and update streams.

    header, 48 bytes: magic, version (u32), start_slot, end_slot, entry_count, data_size (u64), checksum (u32), padding
    entry, 64 bytes and data: size (u32), padding, slot, write_version (u64), pubkey, data_len, reserved (u32)

The source "delta_segment" reads them in batch, and as a stream whose offset names the segments taken.  It writes them too, in batch and from
a stream: a task starts another segment at ROLL_ENTRIES entries, and segments get their names when the job commits.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
HEADER, ENTRY = struct.Struct("<IIQQQQI4x"), struct.Struct("<I4xQQ32sII")
MAGIC, VERSION = 0x5345474D, 1
#: Entries from which on a segment is closed (a fixed value).
ROLL_ENTRIES = 1000

SCHEMA = T.StructType([T.StructField("slot", T.LongType()), T.StructField("write_version", T.LongType()), T.StructField("pubkey", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("segment", T.StringType()), T.StructField("offset", T.LongType())])


def pack_entry(slot: int, write_version: int, pubkey: bytes, data: bytes) -> bytes:
    return ENTRY.pack(ENTRY.size + len(data), slot, write_version, pubkey, len(data), 0) + data


def pack_segment(entries: list[tuple[int, int, bytes, bytes]], start_slot: int) -> bytes:
    body = b"".join(pack_entry(*e) for e in entries)
    head = [MAGIC, VERSION, start_slot, max([start_slot, *(e[0] for e in entries)]), len(entries), len(body)]
    return HEADER.pack(*head, zlib.crc32(HEADER.pack(*head, 0)[:44])) + body


def segment_info(content: bytes) -> dict:
    """Header fields; ValueError where magic or version is another, or the checksum is not that of the fields."""
    if len(content) < HEADER.size:
        raise ValueError("no whole segment header")
    magic, version, start, end, count, size, checksum = HEADER.unpack_from(content)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"no segment of version {VERSION}: {magic:#x}, {version}")
    if zlib.crc32(bytes(content[:40]) + bytes(4)) != checksum:
        raise ValueError("the header's checksum does not fit")
    return {"start_slot": start, "end_slot": end, "entry_count": count, "data_size": size, "checksum": checksum}


def entries(content: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(offset, slot, write_version, pubkey, data); a cut-off last entry is left out."""
    segment_info(content)
    at = HEADER.size
    while at + ENTRY.size <= len(content):
        size, slot, wv, pubkey, n, _ = ENTRY.unpack_from(content, at)
        if size != ENTRY.size + n:
            raise ValueError(f"corrupt entry at {at}")
        if at + size > len(content):
            return
        yield at, slot, wv, pubkey, bytes(content[at + ENTRY.size : at + size])
        at += size


def _files(path: str) -> list[str]:
    root = path.removeprefix("file://").removeprefix("file:")
    names = [root] if os.path.isfile(root) else [os.path.join(root, n) for n in os.listdir(root)]
    return sorted(n for n in names if os.path.isfile(n) and not os.path.basename(n).startswith(("_", ".")))


def _read(path: str) -> Iterator[tuple]:
    """Entries of a file, which is mapped and not loaded."""
    with open(path, "rb") as f:
        if os.fstat(f.fileno()).st_size < HEADER.size:
            raise ValueError(f"no whole segment header in {path}")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:
            for at, slot, wv, pubkey, data in entries(content):
                yield slot, wv, pubkey, data, os.path.basename(path), at


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(p) for p in _files(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(partition.path)


class StreamReader(DataSourceStreamReader):
    """Segments, a partition each.  The offset names the segments that are there, so each is read once, whatever its name and
    whenever it comes; it is as long as the folder's listing, from which callers remove what they have compacted."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segments": []}

    def latestOffset(self) -> dict:
        return {"segments": [os.path.basename(p) for p in _files(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        taken, now = set(start["segments"]), set(end["segments"])
        return [Part(p) for p in _files(self.path) if (n := os.path.basename(p)) in now and n not in taken]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _read(partition.path)

    def commit(self, end: dict) -> None:
        pass


class Message(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter, DataSourceStreamWriter):
    """Each task writes segments under names of its attempt; a commit gives them their names, so a lost attempt leaves none.

    Options: roll (entries of a segment), capacity (bytes in the folder, beyond which a write fails)."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.roll, self.capacity = int(options.get("roll", ROLL_ENTRIES)), int(options.get("capacity", 0))
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows) -> Message:
        names, held = [], []

        def close():
            body = pack_segment(held, min(e[0] for e in held))
            if self.capacity and len(body) + sum(os.path.getsize(p) for p in _files(self.path)) > self.capacity:
                raise ValueError(f"{self.path} is full")
            names.append(f"_attempt-{uuid.uuid4().hex}")
            with open(os.path.join(self.path, names[-1]), "wb") as f:
                f.write(body)
            held.clear()

        for r in rows:
            held.append((int(r.slot), int(r.write_version), bytes(r.pubkey), bytes(r.data or b"")))
            if len(held) >= self.roll:
                close()
        if held:
            close()
        return Message(names)

    def commit(self, messages, batch_id: int | None = None) -> None:
        stem = f"batch-{batch_id:012d}" if batch_id is not None else f"part-{uuid.uuid4().hex}"
        if batch_id is not None:  # a batch that is committed again replaces its segments
            for p in _files(self.path):
                if os.path.basename(p).startswith(f"{stem}-"):
                    os.remove(p)
        for i, name in enumerate(n for m in messages if m for n in m.names):
            os.rename(os.path.join(self.path, name), os.path.join(self.path, f"{stem}-{i:06d}.seg"))

    def abort(self, messages, batch_id: int | None = None) -> None:
        for m in messages:
            for n in m.names if m else []:
                if os.path.exists(p := os.path.join(self.path, n)):
                    os.remove(p)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delta_segment"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options)

    def streamWriter(self, schema, overwrite) -> Writer:
        return Writer(self.options)


def with_base_fields(delta: DataFrame, base: DataFrame) -> DataFrame:
    """Segments carry no owner, lamports and so on: those come from the key's base row."""
    missing = [c for c in base.columns if c not in delta.columns and c != "location"]
    return delta.join(base.select("pubkey", *missing), "pubkey", "left").withColumn("storage_type", F.lit("delta"))


def catalog(delta: DataFrame, segment: str = "segment") -> DataFrame:
    """Entries, bytes and slots of each segment."""
    return delta.groupBy(segment).agg(F.count("*").alias("entry_count"), F.sum(F.octet_length("data") + ENTRY.size).alias("data_size"), F.min("slot").alias("start_slot"), F.max("slot").alias("end_slot"))


def latest_slot(delta: DataFrame) -> DataFrame:
    return delta.agg(F.max("slot").alias("latest_slot"))


def without_segments(delta: DataFrame, names: DataFrame, segment: str = "segment") -> DataFrame:
    """delta without the segments named (a table with one column)."""
    return delta.join(names.select(F.col(names.columns[0]).alias(segment)), segment, "left_anti")


def remove_through(path: str, root: int) -> list[str]:
    """Deletes the segments whose entries are all at or below the root, and returns their names."""
    gone = []
    for p in _files(path):
        with open(p, "rb") as f:
            if segment_info(f.read(HEADER.size))["end_slot"] <= root:
                gone.append(os.path.basename(p))
    for name in gone:
        os.remove(os.path.join(path.removeprefix("file://").removeprefix("file:"), name))
    return gone

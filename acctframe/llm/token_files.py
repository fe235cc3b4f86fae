"""Token-ID output: length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard file is a run of records in ascending doc_id order, one shard after the other:

    u64 length | u32 masked CRC-32 of the 8 length bytes | payload | u32 masked CRC-32 of the payload | 0x0A

All integers are little-endian; masked(c) = rotate_right(c, 15) + 0xA282EAD8.  A payload is u8 flags (1: has a doc_id,
2: 32-bit ids), i64 doc_id, u32 count, then the ids, 16 or 32 bits each.  The files go out through Spark's own text
sink (the closing 0x0A is its line end), so any file system that Spark knows will do, and a lost executor's attempt
is never seen.  The index is a Parquet table: shard, offset, length, doc_id, n_tokens, local_start, ids_crc32.

Defined cases: a null text is an empty text and gives just the end id; a null doc_id is kept, as null, and comes first;
rows that share a doc_id each get a record, ordered by the hash of their text; an empty table gives no shard and an empty index; other
columns are not read, whatever their names.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acctframe.llm import _bpe, _io, _text

MASK_DELTA = 0xA282EAD8
#: Bytes of text for one shard, and shards at most.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 15
#: Bytes of text that are encoded at once.
SLICE = 1 << 21
HEAD = struct.Struct("<BqI")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its closing line feed, which the sink adds."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def frames(content: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length with all framing, payload) of every record; raises ValueError where a checksum fails."""
    view, at = memoryview(content), 0
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError(f"record at {at} is cut off")
        (size,) = struct.unpack_from("<Q", view, at)
        if struct.unpack_from("<I", view, at + 8)[0] != masked(zlib.crc32(view[at : at + 8])) or at + 17 + size > len(view):
            raise ValueError(f"bad length at {at}")
        payload = view[at + 12 : at + 12 + size]
        if struct.unpack_from("<I", view, at + 12 + size)[0] != masked(zlib.crc32(payload)) or view[at + 16 + size] != 10:
            raise ValueError(f"bad payload at {at}")
        yield at, 17 + size, payload
        at += 17 + size


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return HEAD.pack((doc_id is not None) | (wide << 1), doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = HEAD.unpack_from(payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", count=n, offset=HEAD.size).astype("<u4")


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, end = _bpe.encoder(path), np.array([end_id], "<u4")
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        ids, at = enc.batch(data, offs)
        out = [frame(pack(d, np.concatenate((ids[at[i] : at[i + 1]], end)))) for i, d in enumerate(rows.column("doc_id").to_pylist())]
        yield pa.record_batch({"record": pa.array(out, pa.binary())})


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes docs (doc_id, text) and writes the shards to the folder `out`, in ascending doc_id order over all shards.

    The text's hash and the row's place stand behind doc_id in the order, so rows that share a doc_id can part over several shards."""
    shards = min(MOST_SHARDS, max(1, -(-_io.text_bytes(docs) // shard_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    records = ordered.mapInArrow(partial(_encode, path=vocabulary, end_id=end_id), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(out)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            shard = int(re.search(r"part-(\d+)", path)[1])
            rows, before = [], 0
            for at, size, payload in frames(content.as_buffer()):
                doc_id, ids = unpack(payload)
                rows.append((shard, at, size, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                before += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=INDEX.names)


INDEX = pa.schema([(n, pa.int64()) for n in ("shard", "offset", "length", "doc_id", "n_tokens", "local_start", "ids_crc32")])


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path", "content")


def build_index(spark: SparkSession, out: str) -> DataFrame:
    """Reads every shard, checks all checksums, and gives one index row a record."""
    return _files(spark, out).mapInArrow(_index, ", ".join(f"{n} long" for n in INDEX.names))


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all records before this one.  One row a shard meets in the window."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(w), F.lit(0)).alias("base"))
    return index.join(base, "shard").withColumn("start", F.col("base") + F.col("local_start"))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, wanted = batch.column("content"), batch.column("wanted").to_pylist()
        for buf, spots in zip(content, wanted, strict=True):
            view, rows = memoryview(buf.as_buffer()), []
            for s in spots:
                _, _, payload = next(frames(view[s["offset"] : s["offset"] + s["length"]]))
                doc_id, ids = unpack(payload)
                rows.append((s["rank"], doc_id, ids.astype(np.int64)))
            yield pa.record_batch({"rank": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})


def shuffled_read(spark: SparkSession, out: str, index: DataFrame, seed: int, n: int) -> DataFrame:
    """The n records that come first in the seed's order, with their rank key; only the shards that hold one are opened."""
    rank = F.xxhash64(F.lit(seed), "shard", "offset")
    wanted = index.select("shard", "offset", "length", rank.alias("rank")).orderBy("rank").limit(n)
    spots = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", "length", "rank")).alias("wanted"))
    files = _files(spark, out).withColumn("shard", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))
    return files.join(spots, "shard").select("content", "wanted").mapInArrow(_fetch, "rank long, doc_id long, ids array<bigint>").orderBy("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _io.new_path(spark, "token-files")
    write_token_files(_io.table(spark, sf_dir, "documents"), out, _bpe.default_vocabulary())
    _io.release(spark)
    index = _io.stored(build_index(spark, out), "token-index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")

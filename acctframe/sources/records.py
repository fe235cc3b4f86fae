"""The packed record format of base files, as a Spark data source named "accounts".

A directory holds files named {number}.{anything}; each is a run of records:

    [0,8) stored_size  [8,40) pubkey  [40,72) owner  [72] executable  [73,81) rent_epoch  [81,89) lamports
    [89,97) slot  [97,stored_size) data, little-endian; the next record begins at a multiple of eight.

Files go through Spark's binary reader where `scan` is used, so any file system will do; the data source proper
reads local or mounted paths, one partition a file.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from acctframe import shared
from acctframe.schemas import ACCOUNTS, LOCATION

#: Fixed values of the format.
HEADER = struct.Struct("<Q32s32sBQQQ")
FILE_MAGIC, FILE_HEADER = struct.pack("<II", 0xC0000000, 0), 8


def aligned(n: int) -> int:
    return -(-n // 8) * 8


def padding(n: int) -> int:
    return aligned(n) - n


def file_id(path: str) -> int | None:
    m = re.match(r"(\d+)\.", os.path.basename(path))
    return int(m[1]) if m and int(m[1]) < 1 << 64 else None


def has_header(content: bytes) -> bool:
    return content[:FILE_HEADER] == FILE_MAGIC


def pack_record(pubkey: bytes, owner: bytes, data: bytes, lamports: int = 0, slot: int = 0, rent_epoch: int = 0, executable: bool = False) -> bytes:
    size = HEADER.size + len(data)
    return HEADER.pack(size, pubkey, owner, executable, rent_epoch, lamports, slot) + data + b"\0" * padding(size)


def parse_record(file: int, at: int, content: bytes) -> dict | None:
    """The record at a place, or None where the file does not hold one there."""
    if at + 8 > len(content):
        return None
    (size,) = struct.unpack_from("<Q", content, at)
    if size < HEADER.size or at + size > len(content):
        return None
    _, pubkey, owner, executable, rent_epoch, lamports, slot = HEADER.unpack_from(content, at)
    place = {"file_id": file, "offset": at, "stored_size": size, "data_offset": HEADER.size, "data_len": size - HEADER.size, "slot": slot, "write_version": 0, "storage_type": "base"}
    return {"pubkey": pubkey, "lamports": Decimal(lamports), "data": bytes(content[at + HEADER.size : at + size]), "owner": owner, "executable": bool(executable), "slot": slot, "write_version": 0, "rent_epoch": Decimal(rent_epoch), "storage_type": "base", "location": place}


#: Where fields stand in a record: format and offset.
FIELDS = {"stored_size": ("<Q", 0), "pubkey": ("<32s", 8), "owner": ("<32s", 40), "executable": ("<B", 72), "rent_epoch": ("<Q", 73), "lamports": ("<Q", 81), "slot": ("<Q", 89)}


def read_field(content: bytes, at: int, name: str):
    """One field of the record at a place, without the others; data_len is a field too.  None where there is no whole record."""
    if not is_record(content, at):
        return None
    if name == "data_len":
        return struct.unpack_from("<Q", content, at)[0] - HEADER.size
    value = struct.unpack_from(FIELDS[name][0], content, at + FIELDS[name][1])[0]
    return bool(value) if name == "executable" else value


def is_record(content: bytes, at: int) -> bool:
    if at < 0 or at + 8 > len(content):
        return False
    (size,) = struct.unpack_from("<Q", content, at)
    return size >= HEADER.size and at + size <= len(content)


def read_range(content: bytes, offset: int, length: int) -> bytes:
    """Bytes of a file; ValueError where they go beyond it."""
    if offset < 0 or length < 0 or offset + length > len(content):
        raise ValueError(f"no bytes {offset} to {offset + length} in a file of {len(content)}")
    return bytes(content[offset : offset + length])


def data_at(content: bytes, place: dict) -> bytes:
    """The data of a record at a place (offset, data_offset, data_len)."""
    return read_range(content, place["offset"] + place["data_offset"], place["data_len"])


def parse_file(file: int, content: bytes, header: str = "false") -> Iterator[dict]:
    """All records; one that is too short is skipped, a size of 0 or beyond the end ends the file."""
    at = FILE_HEADER if header == "true" or header == "auto" and has_header(content) else 0
    while at + 8 <= len(content):
        (size,) = struct.unpack_from("<Q", content, at)
        if size == 0 or at + size > len(content):
            return
        if (row := parse_record(file, at, content)) is not None:
            yield row
        at = aligned(at + size)


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ACCOUNTS)


class FilePart(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.header = options["path"], options.get("header", "false").lower()

    def partitions(self) -> list[FilePart]:
        root = self.path.removeprefix("file://").removeprefix("file:")
        names = [root] if os.path.isfile(root) else [os.path.join(root, n) for n in os.listdir(root)]
        found = sorted((n, p) for p in names if os.path.isfile(p) and (n := file_id(p)) is not None)
        if not found:
            raise ValueError(f"no account files in {self.path}")
        return [FilePart(p, n) for n, p in found]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:  # mapped, not loaded
                yield from batches(parse_file(partition.number, content, self.header))


def batches(rows: Iterator[dict], most: int = 5000) -> Iterator[pa.RecordBatch]:
    schema, held = _arrow_schema(), []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class Message(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    """Writes one file per task; files get their names when the job commits, so a lost attempt leaves none."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows) -> Message:
        import uuid

        name, n = f"_attempt-{uuid.uuid4().hex}", 0
        with open(os.path.join(self.path, name), "wb") as f:
            for r in rows:
                f.write(pack_record(bytes(r.pubkey), bytes(r.owner), bytes(r.data or b""), int(r.lamports or 0), int(r.slot or 0), int(r.rent_epoch or 0), bool(r.executable)))
                n += 1
        return Message([name] if n else [])

    def commit(self, messages) -> None:
        taken = [i for n in os.listdir(self.path) if (i := file_id(n)) is not None]
        for i, name in enumerate((n for m in messages if m for n in m.names), max(taken, default=-1) + 1):
            os.rename(os.path.join(self.path, name), os.path.join(self.path, f"{i}.0"))

    def abort(self, messages) -> None:
        for m in messages:
            for n in m.names if m else []:
                if os.path.exists(p := os.path.join(self.path, n)):
                    os.remove(p)


class AccountsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "accounts"

    def schema(self):
        return ACCOUNTS

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite) -> Writer:
        return Writer(self.options)


def _parse(parts: Iterator[pa.RecordBatch], header: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for path, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
            if (number := file_id(path)) is not None:
                view = memoryview(content.as_buffer())
                yield from batches(parse_file(number, view, header)) if columns is None else _pruned(number, view, header, columns)


def _pruned(file: int, content: memoryview, header: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Only some fields of each record; data is not copied unless it is among them."""
    at, held = FILE_HEADER if header == "true" or header == "auto" and has_header(content) else 0, []
    schema = _pruned_schema(columns)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    while at + 8 <= len(content):
        (size,) = struct.unpack_from("<Q", content, at)
        if size == 0 or at + size > len(content):
            break
        if size >= HEADER.size:
            held.append([file if c == "file_id" else at if c == "offset" else bytes(content[at + HEADER.size : at + size]) if c == "data" else read_field(content, at, c) for c in columns])
        at = aligned(at + size)
        if len(held) == 5000:
            yield batch()
            held = []
    if held:
        yield batch()


#: Types of the fields that a pruned scan can give.
PRUNED = {"pubkey": "binary", "owner": "binary", "data": "binary", "executable": "boolean", "slot": "long", "stored_size": "long", "data_len": "long", "file_id": "long", "offset": "long", "lamports": "decimal(20,0)", "rent_epoch": "decimal(20,0)"}


def _pruned_schema(columns: list[str]) -> pa.Schema:
    kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
    return pa.schema([(c, kinds[PRUNED[c]]) for c in columns])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan(spark: SparkSession, path: str, header: str = "false", columns: list[str] | None = None) -> DataFrame:
    """All records below a path on any file system that Spark reads; a file is one task's work at most.

    With columns (of PRUNED) the others are not decoded."""
    kind = ACCOUNTS if columns is None else ", ".join(f"{c} {PRUNED[c]}" for c in columns)
    return _files(spark, path).mapInArrow(partial(_parse, header=header, columns=columns), kind)


def _fetched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pos", pa.int64()), *_arrow_schema()])
    for part in parts:
        for path, content, wanted in zip(part.column("path").to_pylist(), part.column("content"), part.column("wanted").to_pylist(), strict=True):
            view, rows = memoryview(content.as_buffer()), []
            for w in wanted:
                if (row := parse_record(file_id(path), w["offset"], view)) is not None:
                    rows.append({"pos": w["pos"], **row})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_batch(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Records at requested places (pos, file_id, offset), in order of pos: pos, the record's fields, and error, which says of a
    place without one whether its file is not there or holds no record at that offset.  Only files that are asked for are read."""
    listed = requests.groupBy("file_id").agg(F.collect_list(F.struct("pos", "offset")).alias("wanted"))
    numbered = spark.read.format("binaryFile").load(path).withColumn("file_id", F.regexp_extract("path", r"/(\d+)\.[^/]*$", 1).cast("long"))
    there = numbered.select(F.col("file_id").alias("__file")).distinct()  # paths alone
    kind = "pos long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ACCOUNTS)
    got = numbered.join(listed, "file_id").select("path", "content", "wanted").mapInArrow(_fetched, kind)
    asked = requests.select("pos", F.col("file_id").alias("asked_file"), F.col("offset").alias("asked_offset"))
    out = asked.join(there, asked.asked_file == there["__file"], "left").join(got, "pos", "left")
    error = F.when(F.col("__file").isNull(), "unknown file").when(F.col("pubkey").isNull(), "no record")
    return out.select("pos", "asked_file", "asked_offset", *[f.name for f in ACCOUNTS], error.alias("error")).orderBy("pos")


def scan_stats(accounts: DataFrame) -> DataFrame:
    return accounts.agg(F.count_distinct("location.file_id").alias("files"), F.count("*").alias("accounts"), F.coalesce(F.sum("location.stored_size"), F.lit(0)).alias("bytes"), F.avg("location.data_len").alias("mean_data_len"))


def at_offset(accounts: DataFrame, file: int, offset: int) -> DataFrame:
    return accounts.where((F.col("location.file_id") == file) & (F.col("location.offset") == offset))


def locate(accounts: DataFrame, pubkey: bytes) -> DataFrame:
    """The first record of a key in file order."""
    return accounts.where(F.col("pubkey") == F.lit(bytearray(pubkey))).orderBy("location.file_id", "location.offset").limit(1)


def bootstrap(spark: SparkSession, path: str, out: str, partitions: int, header: str = "false") -> None:
    """Rewrites base files once as Parquet: latest version of each key, range-sorted by it, with bloom filters for point reads."""
    from acctframe.operators.predicates import with_index_columns
    from acctframe.operators.versions import latest

    rows = scan(spark, path, header).withColumn("__file", F.col("location.file_id")).withColumn("__at", F.col("location.offset"))
    newest = latest(rows, ties=("__file", "__at")).drop("__file", "__at")
    with_index_columns(newest).repartitionByRange(partitions, "pubkey").sortWithinPartitions("pubkey").write.option("parquet.bloom.filter.enabled#pubkey", "true").parquet(out)


class Locator:
    """Where each key's record is: a Parquet log of insertions and deletions by number, of which the newest counts.

    compact() rewrites the log as a new generation, range-sorted by key with a bloom filter, and drops the old one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.generation = max((int(n.split("=")[1]) for n in shared.children(spark, self.path) if n.startswith("generation=")), default=0)
        self.seq = self._log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    @property
    def _at(self) -> str:
        return f"{self.path}/generation={self.generation}"

    def _log(self) -> DataFrame:
        kind = T.StructType([T.StructField("pubkey", T.BinaryType()), T.StructField("location", LOCATION), T.StructField("seq", T.LongType())])
        return self.spark.read.schema(kind).parquet(self._at) if shared.exists(self.spark, self._at) else self.spark.createDataFrame([], kind)

    def _append(self, rows: DataFrame) -> None:
        self.seq += 1
        rows.withColumn("seq", F.lit(self.seq).cast("long")).write.mode("append").parquet(self._at)

    def insert(self, rows: DataFrame) -> None:
        """rows: pubkey, location; a key that is there gets the new place."""
        self._append(rows.select("pubkey", "location"))

    def delete(self, keys: DataFrame) -> None:
        self._append(keys.select("pubkey", F.lit(None).cast(LOCATION).alias("location")))

    def _newest(self, log: DataFrame) -> DataFrame:
        best = log.groupBy("pubkey").agg(F.max_by("location", F.struct("seq", "location.slot", "location.write_version", "location.file_id", "location.offset")).alias("location"))
        return best.where("location is not null")

    def table(self) -> DataFrame:
        return self._newest(self._log())

    def get_batch(self, keys: list[bytes]) -> DataFrame:
        """pos, key, location (null for misses), in order; the keys go into the scan."""
        from acctframe.operators import predicates as P

        asked = P.requested(self.spark, keys, "binary")
        return P.in_request_order(asked, self._newest(self._log().where(F.col("pubkey").isin([P.literal(k) for k in keys])))).select("pos", "key", "location")

    def get(self, key: bytes) -> DataFrame:
        return self._newest(self._log().where(F.col("pubkey") == F.lit(bytearray(key)))).select("location")

    def count(self) -> int:
        return self.table().count()

    def compact(self, partitions: int) -> None:
        old, rows = self._at, self.table().withColumn("seq", F.lit(self.seq).cast("long"))
        new = f"{self.path}/generation={self.generation + 1}"
        rows.repartitionByRange(partitions, "pubkey").sortWithinPartitions("pubkey").write.option("parquet.bloom.filter.enabled#pubkey", "true").parquet(new)
        self.generation += 1
        shared.delete_path(self.spark, old)

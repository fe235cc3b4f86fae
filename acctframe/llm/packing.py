"""Packing along a Hilbert curve: neighbouring documents share sequences.

Every document becomes a hashed bag of words, projected with random signs to four numbers, which the normal
distribution function spreads evenly over a grid; the grid cell's place on the Hilbert curve is the sort key, with a
hash of doc_id, text and place in the input behind it, so equal keys (copies) can part over several tasks.  Projected rows
are stored once.  Ranges of the curve are cut where a sample of them, drawn by their bytes, has equal shares of
all bytes, so a task's work does not depend on how long its documents are.  Each task cuts its
stream of ids into full sequences.  What is left at the end of a task, less than one sequence, is joined with the rests of
the next tasks on the curve, 1024 tasks at a time, so at most one sequence per 1024 tasks is padded.

Defined cases: a null or empty text is one token, the end id; null doc_ids and repeated rows are packed like all others;
an empty table gives no row; other columns are not read, whatever their names.  Texts are packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _bpe, _io, _text

SEQUENCE = 2048
DIMENSIONS, BITS = 4, 15
#: Bytes of text for one task, tasks at most, and tasks whose rests are packed together.
TASK_BYTES, MOST_TASKS, TASKS_TOGETHER = 16 << 20, 1 << 15, 1024
#: Bytes that a row counts besides its text, and sampled rows a task: the driver sees SAMPLED * MOST_TASKS of them at most.
ROW_BYTES, SAMPLED = 64, 24
#: Bytes of text that are encoded at once.
SLICE = 1 << 21
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, seq long, offset long, rest binary"


def hilbert_key(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid (points x dimensions, values below 2**bits).

    The reflections and exchanges of the curve's cells are undone from the coarsest bit to the finest, then the
    Gray code of the interleaved bits is turned into a number.
    """
    x = [grid[:, d].astype(np.int64) for d in range(grid.shape[1])]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(len(x)):
            up = (x[d] >> b) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[d]
    key, parity = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            parity ^= (x[d] >> b) & 1
            key = (key << 1) | parity
    return key


#: Words from which on a longer text is projected no farther from the middle.
ENOUGH = 256


def project(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Grid point of each text: mean signs of its hashed words, scaled by their number (ENOUGH at most) and spread evenly."""
    docs = len(offs) - 1
    starts, ends, doc = _text.words(data, offs)
    h = _text.word_hashes(_text.LOWER[data], starts, ends)
    n = np.maximum(np.bincount(doc, minlength=docs), 1)
    out = np.empty((docs, DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((h >> np.uint64(11 * d + 5)) & np.uint64(1)).astype(np.float64) * 2 - 1
        z = np.bincount(doc, weights=sign, minlength=docs) / n * np.sqrt(np.minimum(n, ENOUGH))
        out[:, d] = np.clip((1 / (1 + np.exp(-1.702 * z / 2))) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return out


KEYED = "doc_id long, text string, curve long, tie long, size long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for rows, data, offs in _text.text_slices(batches):
        # 43 bits of doc_id and text, then 20 of the row's place, which only tells equal rows apart
        what = rows.column("th").to_numpy(zero_copy_only=False).view(np.uint64) ^ _text.mix64(pc.fill_null(rows.column("doc_id"), -1).to_numpy(zero_copy_only=False).view(np.uint64))
        place = _text.mix64(np.arange(row, row + rows.num_rows, dtype=np.uint64))
        tie = (_text.mix64(what) >> np.uint64(21) << np.uint64(20)) | (place >> np.uint64(44))
        row += rows.num_rows
        made = (hilbert_key(project(data, offs), BITS), _text.to_i64(tie), np.diff(offs) + ROW_BYTES)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), *map(pa.array, made)], names=["doc_id", "text", "curve", "tie", "size"])


def _together(curve: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Both keys as 16 bytes that compare as they do."""
    return np.ascontiguousarray(np.stack((curve, tie), 1).astype(">u8")).view("S16").ravel()


def cuts(keyed: DataFrame, total: int, tasks: int) -> np.ndarray:
    """The first keys of all ranges but the first."""
    share = max(1, total // (tasks * SAMPLED))
    spin = F.pmod(F.xxhash64("curve", "tie"), F.lit(1 << 30)) / float(1 << 30)
    seen = keyed.where(spin * share < F.col("size")).select("curve", "tie", F.greatest("size", F.lit(share)).alias("size")).toArrow()
    key, size = _together(seen.column("curve").to_numpy(), seen.column("tie").to_numpy()), seen.column("size").to_numpy()
    order = np.argsort(key)
    at = np.cumsum(size[order])
    return np.unique(key[order][np.searchsorted(at, at[-1] * np.arange(1, tasks) / tasks)]) if len(at) else key


def _deal(batches: Iterator[pa.RecordBatch], bounds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _together(batch.column("curve").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False))
        part = np.searchsorted(bounds.value, key, "right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])


class Packer:
    """Cuts a stream of documents' ids into sequences; gives a sequence's pieces once it is full."""

    def __init__(self, part: int):
        self.part, self.seq, self.fill, self.open, self.out = part, 0, 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        at, total = 0, len(ids) if doc_tokens is None else doc_tokens
        while at < len(ids):
            n = min(SEQUENCE - self.fill, len(ids) - at)
            self.open.append((doc_id, start + at, n, ids[at : at + n], total, self.fill))
            self.fill += n
            at += n
            if self.fill == SEQUENCE:
                self.close(False)

    def close(self, rest: bool) -> None:
        for doc_id, start, n, ids, total, offset in self.open:
            raw = ids.tobytes()
            self.out.append((doc_id, start, n, zlib.crc32(raw), total, self.part, self.seq, offset, raw if rest else None))
        self.open, self.fill, self.seq = [], 0, self.seq + 1

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 9
        self.out = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())], names=[c.split()[0] for c in PIECES.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    packer, enc, end = Packer(TaskContext.get().partitionId()), _bpe.encoder(path), np.array([end_id], "<u4")
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        ids, at = enc.batch(data, offs)
        for i, d in enumerate(rows.column("doc_id").to_pylist()):
            packer.add(d, np.concatenate((ids[at[i] : at[i + 1]], end)))
        yield packer.take()
    packer.close(True)
    yield packer.take()


def _pack_rests(key, rests):
    import pandas as pd

    packer = Packer((1 << 30) + int(key[0]))
    for r in rests.sort_values(["part", "offset"]).itertuples(index=False):
        packer.add(None if pd.isna(r.doc_id) else int(r.doc_id), np.frombuffer(r.rest, "<u4"), int(r.start), int(r.doc_tokens))
    packer.close(False)
    return packer.take().to_pandas().astype({"doc_id": "Int64"})


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    keyed = _io.stored(rows.mapInArrow(_keys, KEYED), "curve")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bounds = cuts(keyed, total, min(MOST_TASKS, max(1, -(-total // TASK_BYTES))))
    dealt = keyed.select("doc_id", "text", "curve", "tie").mapInArrow(partial(_deal, bounds=spark.sparkContext.broadcast(bounds)), "doc_id long, text string, curve long, tie long, part int")
    ordered = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("curve", "tie").select("doc_id", "text")
    made = _io.stored(ordered.mapInArrow(partial(_pack, path=vocabulary, end_id=end_id), PIECES), "packed")
    _io.drop_stored(keyed)
    rests = made.where("rest is not null").withColumn("group", F.col("part") / F.lit(TASKS_TOGETHER)).withColumn("group", F.floor("group"))
    rests = rests.groupBy("group").applyInPandas(_pack_rests, PIECES)
    return made.where("rest is null").unionByName(rests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("part", 32) + F.col("seq")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_io.table(spark, sf_dir, "documents"), _bpe.default_vocabulary())

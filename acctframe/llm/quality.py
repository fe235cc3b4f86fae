"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are read twice: as lower-cased spellings and as shapes (case, length class, punctuation and its kind, digits,
whether the word repeats the one before).  Spellings give 1- and 2-grams, shapes 1- to 3-grams; each n-gram is hashed to
one of 2**BITS places, and a text is the sparse vector of its n-grams' shares of its words.  A score is the logistic
function of a sparse dot product.

The model is fitted on TRAIN_ROWS labelled documents and TRAIN_BYTES of their text at most (in the order of the hash of doc_id), documented
bounds; scoring reads whole texts of all rows.

Defined cases: a null or empty text has the score of the bias alone; labels whose quality is not 0 or 1 or without a document are
left out, repeated labels count once (the largest), and so does a labelled doc_id with several rows (the text of least hash); without any label every score is 0.5; null doc_ids and repeated rows
are scored like others; an empty table gives no row; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from acctframe.llm import _io, _text

BITS, TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 18, 6_000, 128 << 20, 2
#: FTRL-proximal: learning rate, its smoothing, and the L1 and L2 weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Weight of an n-gram stream's shares: spellings by length, shapes by length.
SCALE = (3.0, 3.0, 8.0, 8.0, 8.0)
U64 = np.uint64

UPPER, LOWER, DIGIT = (np.zeros(256, np.int64) for _ in range(3))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = 1
LETTER = UPPER + LOWER
LETTER[0x80:] = 1
#: U+00C0..U+00DE are C3 80..C3 9E: their second byte shows the case.
C3_UPPER = np.zeros(256, bool)
C3_UPPER[0x80:0x9F] = True


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A small code for each word's outline."""
    if not len(starts):
        return np.zeros(0, U64)
    upper = UPPER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[second < len(data)]
    upper[second[C3_UPPER[data[second]]]] = 1

    def count(x: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(x)))
        return before[ends] - before[starts]

    size, up, letters, digits = ends - starts, count(upper), count(LETTER[data]), count(DIGIT[data])
    marks = np.minimum(size - letters - digits, 4)
    case = np.where(up == 0, 0, np.where(up == 1, 1, np.where(2 * up >= letters, 3, 2)))
    last = np.where(marks > 0, data[ends - 1].astype(np.int64), 0)
    same = np.zeros(len(starts), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    long = np.searchsorted([2, 5, 9, 14, 24], size)
    return ((((((last * 5 + marks) * 4 + case) * 2 + same) * 6 + long) * 2 + (digits > 0)) + 1).astype(U64)


def streams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each n-gram stream the texts and hash places of its n-grams."""
    starts, ends, doc = _text.words(data, offs)
    h = _text.word_hashes(_text.LOWER[data], starts, ends)
    s = _text.mix64(shapes(data, starts, ends, h, doc))
    n = np.bincount(doc, minlength=len(offs) - 1)
    out = []
    for kind, (grams, most) in enumerate(((h, 2), (s, 3))):
        key, owner = grams, doc
        for k in range(1, most + 1):
            if k > 1:
                together = doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)
                key = key[: len(together)] * U64(_text.BASE) + grams[k - 1 :][: len(together)]
                owner = doc[: len(together)]
                out.append((owner[together], place(key[together], kind, k)))
            else:
                out.append((owner, place(key, kind, k)))
    return n, out


def place(key: np.ndarray, kind: int, k: int) -> np.ndarray:
    return (_text.mix64(key + U64(kind * 8 + k)) >> U64(64 - BITS)).astype(np.int64)


def train(texts: list[str | None], labels: list[int]) -> np.ndarray:
    """Weights of the hash places, and the bias at the end, after EPOCHS passes in the order given."""
    size = 1 << BITS
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, data, offs in _text.text_slices(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        n, parts = streams(data, offs)
        owner = np.concatenate([p[0] for p in parts])
        where = np.concatenate([p[1] for p in parts])
        value = np.concatenate([np.full(len(p[0]), SCALE[i]) for i, p in enumerate(parts)]) / np.maximum(n, 1)[owner]
        keys, inverse = np.unique(owner * size + where, return_inverse=True)
        total = np.bincount(inverse, weights=value)
        cut = np.searchsorted(keys, np.arange(len(offs)) * size)
        rows += [(np.append(keys[a:b] % size, size), np.append(total[a:b], 1.0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA * w
            g2[i] += g * g
    return weights(np.arange(size + 1))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for b in batches:
        for text, quality in zip(b.column("text").to_pylist(), b.column("quality").to_pylist(), strict=True):
            held += len(text or "")
            if held <= TRAIN_BYTES or not rows:
                rows.append((text, quality))
    if rows:
        w = train([r[0] for r in rows], [r[1] for r in rows]).astype("<f4")
        yield pa.record_batch({"weights": pa.array([w.tobytes()], pa.binary())})


def in_fold(doc_id, fold: int = 1):
    """Whether crc32(doc_id as text) mod 3 is the fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == fold


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learnt from the labelled rows outside the held-out fold."""
    order = F.xxhash64("doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most TRAIN_ROWS ids
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))
    model = rows.repartition(1).sortWithinPartitions(order, "doc_id", "text").select("text", "quality").mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(model[0][0], "<f4") if model else np.zeros((1 << BITS) + 1, "<f4")


def scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n, parts = streams(data, offs)
    total = np.zeros(len(offs) - 1)
    for i, (owner, where) in enumerate(parts):
        total += SCALE[i] * np.bincount(owner, weights=weights[where], minlength=len(total))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + weights[-1], -35, 35)))


#: Beside a caller's own columns the score goes by this name, or one that is free.
SCORE = "__quality_score"


def _score(batches: Iterator[pa.RecordBatch], model, name: str = "score") -> Iterator[pa.RecordBatch]:
    weights = np.frombuffer(model.value, "<f4")
    for rows, data, offs in _text.text_slices(batches):
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores(data, offs, weights))], names=[*rows.schema.names, name])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and text with a score from 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights.tobytes())  # 2**BITS + 1 floats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, text string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _io.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents scored 0.5 or more, with all their columns."""
    weights = fit(docs, _io.table(spark, sf_dir, "labels"))
    model = spark.sparkContext.broadcast(weights.tobytes())
    column = _io.fresh(docs, SCORE)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(partial(_score, model=model, name=column), schema).where(F.col(column) >= 0.5).drop(column)

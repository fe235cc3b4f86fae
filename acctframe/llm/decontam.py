"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Normalising lower-cases A-Z and turns every byte that is no word byte into a space, byte for byte, so offsets stay
those of the original; words are then joined by single spaces.  A window is 13 consecutive words of an item, or
all words of a shorter one.  Any 13 consecutive words of an item hold one of its aligned blocks of seven, so
the automaton holds only those blocks (one state a character of the items, not thirteen) and each hit is
extended word by word to the longest run that item and document share; a run of at least a window marks its words.

Items are cut into parts of PART words that overlap by a window less one word, so that every window lies in a part, and equal
parts of an item count once.  Parts are broadcast in blocks of about BLOCK_BYTES; a larger benchmark takes one pass a block.

Defined cases: a null or empty text has no words and is clean; benchmark rows without item_id or without words have no
window; equal items all count; repeated rows and null doc_ids are judged like others; an empty benchmark makes all
documents clean; an empty table gives no row; other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from acctframe.llm import _io, _text

#: Beside a caller's own columns the findings go by this name, or one that is free.
COLUMN = "__decontamination"
WINDOW, ALIGNED = 13, 7
BLOCK_BYTES, PART = 2 << 20, 4096
SEP = np.ones(256, dtype=bool)
SEP[0x30:0x3A] = SEP[0x61:0x7B] = SEP[0x41:0x5B] = SEP[0x80:] = False
NORMAL = bytes(32 if SEP[b] else int(_text.LOWER[b]) for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


class Matcher:
    """Finds the windows of items ((item_id, text) pairs) in documents."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(str(k), w) for k, w in ((k, normal_words((t or "").encode())) for k, t in items if k is not None) if w]
        blocks: dict[str, list[tuple[int, int]]] = {}
        for j, (_, w) in enumerate(self.items):
            step = min(ALIGNED, len(w))
            for b in range(0, len(w) - step + 1, step) if len(w) >= WINDOW else (0,):
                blocks.setdefault(" " + b" ".join(w[b : b + step]).decode("latin-1") + " ", []).append((j, b))
        self.automaton = ahocorasick.Automaton()
        for text, places in blocks.items():
            self.automaton.add_word(text, (len(text), places))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, after) of the document that windows cover, and the ids of the items they are from."""
        if self.empty or not words:
            return [], set()
        norm = b" ".join((b"", *words, b"")).decode("latin-1")
        starts, out, ids, done = None, [], set(), {}
        for end, (size, places) in self.automaton.iter(norm):
            if starts is None:
                lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
                starts = np.cumsum(lengths) - lengths
            i = int(np.searchsorted(starts, end - size + 1))
            for j, b in places:
                if done.get((j, i - b), -1) > i:
                    continue
                w = self.items[j][1]
                low = high = 0
                while low < min(i, b) and words[i - low - 1] == w[b - low - 1]:
                    low += 1
                while high < min(len(words) - i, len(w) - b) and words[i + high] == w[b + high]:
                    high += 1
                done[j, i - b] = i + high
                if low + high >= min(WINDOW, len(w)):
                    out.append((i - low, i + high))
                    ids.add(self.items[j][0])
        return out, ids


_matchers: dict[int, Matcher] = {}


def _matcher(items) -> Matcher:
    if items.id not in _matchers:
        _matchers.clear()
        _matchers[items.id] = Matcher(items.value)
    return _matchers[items.id]


class _Block:
    """A broadcast variable with a number that stays the same in every worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __reduce__(self):
        return _opened, (self.id, self.broadcast)


class _Opened:
    def __init__(self, id: int, broadcast):
        self.id, self.broadcast = id, broadcast

    @property
    def value(self):
        return self.broadcast.value


def _opened(id: int, broadcast) -> _Opened:
    return _Opened(id, broadcast)


FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SO_FAR = pa.struct([("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each item, in overlapping parts."""
    for rows, data, offs in _text.text_slices(batches):
        raw, ids, out = data.tobytes(), [], []
        for i, k in enumerate(rows.column("item_id").to_pylist()):
            words = normal_words(raw[offs[i] : offs[i + 1]])
            for a in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), PART):
                ids.append(k)
                out.append(b" ".join(words[a : a + PART + WINDOW - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["item_id", "words"])


def _scan(batches: Iterator[pa.RecordBatch], items, column: str, more: bool, last: bool) -> Iterator[pa.RecordBatch]:
    match = _matcher(items)
    for rows, data, offs in _text.text_slices(batches):
        raw, before = data.tobytes(), rows.column(column).to_pylist() if more else None
        found = []
        for i in range(rows.num_rows):
            words = normal_words(raw[offs[i] : offs[i + 1]])
            runs, ids = match.runs(words)
            if before:
                flat = before[i]["runs"]
                runs, ids = runs + list(zip(flat[::2], flat[1::2], strict=True)), ids | set(before[i]["items"])
            runs = merged(runs)
            if last:
                hit = sum(b - a for a, b in runs)
                spans = original_spans(data[offs[i] : offs[i + 1]], runs) if runs else []
                found.append({"n_words": len(words), "n_hit": hit, "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= len(words), "spans": spans})
            else:
                found.append({"runs": [x for r in runs for x in r], "items": sorted(ids)})
        own = rows.num_columns - more
        yield pa.RecordBatch.from_arrays([*rows.columns[:own], pa.array(found, FOUND if last else SO_FAR)], names=[*rows.schema.names[:own], column])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(data: np.ndarray, runs: list[tuple[int, int]]) -> list[dict]:
    """Byte ranges in the original text of ranges of words."""
    starts, ends, _ = _text.words(data, np.array([0, len(data)]), SEP)
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with one more column, a struct: n_words, n_hit, n_items, items_sha256, contaminated and spans (byte ranges of hit words)."""
    spark, column = docs.sparkSession, _io.fresh(docs, COLUMN)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = items.mapInArrow(_parts, "item_id long, words string").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    now, fields = docs, docs.schema.fields
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES, in parts of bounded length
        block, last = _Block(spark.sparkContext.broadcast([tuple(r) for r in rows])), k == blocks - 1
        kind = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,spans:array<struct<start:long,end:long>>>" if last else "struct<runs:array<long>,items:array<string>>"
        now = now.mapInArrow(partial(_scan, items=block, column=column, more=k > 0, last=last), StructType([*fields, StructField(column, _parse_datatype_string(kind))]))
        if not last:
            now = _io.stored(now, "decontam")
    return now


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan(docs, _io.table(spark, sf_dir, "benchmark")).select("doc_id", *(f"{COLUMN}.{n}" for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated, with their columns."""
    column = _io.fresh(docs, COLUMN)
    return scan(docs, _io.table(spark, sf_dir, "benchmark")).where(~F.col(f"{column}.contaminated")).drop(column)


#: The query in SQL: all windows and all word runs of their lengths, joined by their text.
SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, (SELECT DISTINCT n FROM win))),
hits AS (SELECT r, i, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

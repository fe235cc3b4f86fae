"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else: LENGTH in the query, STAGE_LENGTH in the pipeline.

1. Each window of so many bytes is named by the smallest hash among its K-byte strings (the leftmost on a tie), which depends on its bytes
   only; neighbouring windows with the same one form a segment of a document.  Equal windows therefore lie in
   segments of the same name, at the same distance from it.
2. Segments with equal bytes (by two 64-bit hashes, the name and one of all bytes) repeat as a whole.  One of each kind goes on if other kinds share its name.
3. Those are dealt to shards by name.  A shard sorts all suffixes of its segments by Larsson-Sadakane refinement, finds
   common prefixes by Kasai's recurrence, and marks windows that share that many bytes with a neighbour.
4. A name with more than SHARD_KINDS kinds is dealt over several shards; each also gives the sorted digests of its windows,
   cut in ranges, and the shards' lists of a range are merged by binary search.

Defined cases: a null or empty text, or one that is shorter, loses nothing; repeated rows are copies of each other, and
both go; rows are told apart by doc_id (null included) and content; an empty table gives no row; other columns
are not read, and may have any name.  Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _io, _text

LENGTH, K = 400, 32
#: In the pipeline passages of over 50 words go; 51 words of four letters, with their spaces, are this long.
STAGE_LENGTH = 51 * 5
#: Beside a caller's own columns the byte ranges go by this name, or one that is free.
RANGES = "__repeated_ranges"
SHARD_KINDS = 2048
U64 = np.uint64


#: Windows of a text that are named at once; a segment that lies over the edge counts as two, which only costs a comparison.
NAME_BLOCK = 1 << 20


def window_names(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first windows, window counts, names) of the segments of a text of `length` bytes or more."""
    parts = []
    for at in range(0, len(data) - length + 1, NAME_BLOCK):
        first, count, name = _window_names(data[at : at + NAME_BLOCK + length - 1], length)
        parts.append((first + at, count, name))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _window_names(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, width = data.astype(U64) + U64(1), 1
    while width < K:
        h = h[:-width] * U64(pow(_text.BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h = _text.mix64(h)
    least = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    span, width = length - K + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.diff(np.append(first, len(at))), h[at[first]]


SEGMENTS = "slice long, name long, kind long, windows long, doc_id long, th long, first long, more array<struct<doc_id:long,th:long,first:long>>"


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row per kind of segment in a slice of documents: its first occurrence there, and the others as a list."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for rows, data, offs in _text.text_slices(batches):
        raw, parts = data.tobytes(), []
        for i in np.flatnonzero(np.diff(offs) >= length).tolist():
            base = int(offs[i])
            first, count, name = window_names(data[base : offs[i + 1]], length)
            kind = np.array([xxhash.xxh3_64_intdigest(raw[base + a : base + a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)], U64)
            parts.append((name, kind, count, first, np.full(len(first), i)))
        if parts:
            name, kind, count, first, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((kind, name))
            name, kind, count, first, doc = name[order], kind[order], count[order], first[order], doc[order]
            head = np.concatenate(([True], (name[1:] != name[:-1]) | (kind[1:] != kind[:-1])))
            ids, hashes = rows.column("doc_id").take(pa.array(doc)), rows.column("th").take(pa.array(doc))
            lead, rest = pa.array(np.flatnonzero(head)), pa.array(np.flatnonzero(~head))
            others = pa.StructArray.from_arrays([ids.take(rest), hashes.take(rest), pa.array(first).take(rest)], names=["doc_id", "th", "first"])
            ends = np.concatenate((np.cumsum(~head)[np.flatnonzero(head)], [int((~head).sum())])).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)
            cols = [pa.array(np.full(len(lead), at)), *(pa.array(_text.to_i64(x)).take(lead) for x in (name, kind)), pa.array(count).take(lead), ids.take(lead), hashes.take(lead), pa.array(first).take(lead), more]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "name", "kind", "windows", "doc_id", "th", "first", "more"])
        at += 1


def _whole(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of each document from the repeated segments of its slice."""
    for batch in batches:
        for found in batch.column("found").to_pylist():
            ranges: dict[tuple, list[dict]] = {}
            for f in found:
                size = f["windows"] + length - 1
                for o in (f, *f["more"]):
                    ranges.setdefault((o["doc_id"], o["th"]), []).append({"start": o["first"], "end": o["first"] + size})
            merged = [[{"start": a, "end": b} for a, b in merged_ranges(r)] for r in ranges.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ranges], pa.int64()), pa.array([k[1] for k in ranges], pa.int64()), pa.array(merged, RANGE_LIST)], names=["doc_id", "th", "ranges"])


RANGE_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for rows, data, offs in _text.text_slices(batches):
        raw, out = data.tobytes(), []
        for i, (doc_id, th, wanted) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("th").to_pylist(), rows.column("wanted").to_pylist(), strict=True)):
            for w in wanted:
                at = int(offs[i]) + w["first"]
                out.append((w["shard"], w["name"], w["split"], doc_id, th, w["first"], w["windows"], w["n"], raw[at : at + w["windows"] + length - 1]))
        if out:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "name", "split", "doc_id", "th", "first", "windows", "n", "bytes"])


def loads(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number; zeros stand after the end."""
    x = np.concatenate((text, np.zeros(8, np.uint8))).astype(U64)
    width = 1
    while width < 8:
        x = (x[:-width] << U64(8 * width)) | x[width:]
        width *= 2
    return x[: len(text)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order.  Suffixes are first sorted by eight bytes; then only groups that are still equal are sorted
    by the rank of the suffix that starts where the sorted part ends, which doubles that part each time."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    start, tail = loads(text), np.minimum(n - np.arange(n), 8)
    # zeros after the end set short suffixes first and apart, unless the text has zeros too
    order = np.argsort(start) if text.min() else np.lexsort((tail, start))
    key = start[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (tail[order][1:] != tail[order][:-1])))
    head = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    size = np.diff(np.append(head, n))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    depth = 8
    while len(slots):
        these = order[slots]
        group, then = rank[these], rank[np.minimum(these + depth, n)]
        pair = group * (n + 1) + then + 1
        by = np.argsort(pair)
        these, pair = these[by], pair[by]
        order[slots] = these
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(slots)))
        rank[these] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        depth *= 2
    return order


LANE = 64


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, up to `most`, that each suffix shares with the one before it in order.

    Kasai's recurrence, a suffix loses at most one byte against the suffix that starts one place earlier, is run
    in step for the places 0, LANE, 2 LANE, ..., then for those one further on, and so forth.
    """
    n = len(text)
    eight = np.concatenate((loads(text), np.zeros(1, U64)))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    for step in range(LANE):
        i = np.arange(step, n, LANE)
        had = np.maximum(out[i - 1] - 1, 0) if step else np.zeros(len(i), np.int64)
        have = np.where(before[i] >= 0, had, 0)
        live = np.flatnonzero(before[i] >= 0)
        while len(live):
            a, b, h = i[live], before[i[live]], have[live]
            x = eight[np.minimum(a + h, n)] ^ eight[np.minimum(b + h, n)]
            same = np.full(len(x), 8, np.int64)
            for k in range(8):
                same[(x >> U64(8 * k)) != 0] = 7 - k
            room = np.minimum(most - h, n - np.maximum(a, b) - h)
            have[live] = h + np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        out[i] = have
    return out[order]


def repeated(segments: list[bytes], windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, class) of each window of the segments in order; windows with equal bytes have the same class."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    base = np.cumsum(size) - size
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    owner = np.repeat(np.arange(len(segments)), size)
    place = np.arange(len(text)) - base[owner]
    valid = np.flatnonzero((place < windows[owner])[order])
    low = np.minimum.reduceat(shared, np.append(valid[:-1] + 1, valid[-1:])) if len(valid) > 1 else np.zeros(0, np.int64)
    # entry j is the least common prefix from just after valid window j up to window j + 1
    cls = np.concatenate(([0], np.cumsum(low[: len(valid) - 1] < length))) if len(valid) else np.zeros(0, np.int64)
    at = order[valid]
    return owner[at], place[at], cls


def _runs(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows starting at the sorted places cover."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), (places[np.concatenate((cut, [len(places) - 1]))] + length).tolist(), strict=True))


def _shard(rows: list[dict], length: int) -> tuple[list[tuple], list[tuple]]:
    """Byte ranges that go in segments of a shard, and digest lists of windows whose name is dealt over several shards."""
    windows = np.array([r["windows"] for r in rows])
    owner, place, cls = repeated([r["bytes"] for r in rows], windows, length)
    twice = np.bincount(cls)[cls] > 1
    spans, lists = [], []
    by = np.lexsort((place, owner))
    cuts = np.searchsorted(owner[by], np.arange(len(rows) + 1))
    for s, r in enumerate(rows):
        mine = by[cuts[s] : cuts[s + 1]]
        if r["n"] == 1:
            spans += [(r["doc_id"], r["th"], r["first"] + a, r["first"] + b) for a, b in _runs(place[mine][twice[mine]], length)]
        if r["split"] > 1:
            lists.append((r["name"], r["split"], r["shard"], r["doc_id"], r["th"], r["first"], r["n"], place[mine], digests(r["bytes"], length)[place[mine]]))
    return spans, lists


def digests(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """64-bit digest of each window of `length` bytes."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - length + 1
    out = np.zeros(n, U64)
    for base in (_text.BASE, _text.MIX1):
        inv = pow(base, -1, 1 << 64)
        total = np.concatenate((np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * _text.powers(base, len(data)))))
        out = _text.mix64(out + (total[length:] - total[:n]) * _text.powers(inv, n))
    return out


@_text.trimmed
def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Works off shards that arrive one after the other (rows sorted by shard)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield from _done(held, length)
                held = []
            held.append(row)
    if held:
        yield from _done(held, length)


SHARD_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.int64()), ("range", pa.int64()), ("shard", pa.int64()), ("single", pa.bool_()), ("digests", pa.binary()), ("places", pa.binary())])


def _done(rows: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    spans, lists = _shard(rows, length)
    out = [(*s, None, None, None, None, None, None) for s in spans]
    for name, split, shard, doc_id, th, first, n, place, digest in lists:
        order = np.argsort(digest)
        digest, place = digest[order], place[order] + first
        cuts = np.searchsorted(digest, np.array([(k << 64) // split for k in range(1, split)], U64))
        for k, (d, p) in enumerate(zip(np.split(digest, cuts), np.split(place, cuts), strict=True)):
            if len(d):
                out.append((doc_id, th, None, None, name, k, shard, n == 1, d.tobytes(), p.tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SHARD_OUT, strict=True)], schema=SHARD_OUT)


def _merge(key, lists, length: int):
    """Windows of one name and digest range that several shards hold: each list is searched in the sorted list of shared digests."""
    import pandas as pd

    lists = lists.assign(d=[np.frombuffer(x, U64) for x in lists["digests"]], p=[np.frombuffer(x, np.int64) for x in lists["places"]])
    per_shard = [np.unique(np.concatenate(list(g))) for _, g in lists.groupby("shard")["d"]]
    seen, count = np.unique(np.concatenate(per_shard), return_counts=True)
    shared, out = seen[count > 1], []
    if len(shared):
        for r in lists[lists["single"]].itertuples(index=False):
            hit = shared[np.minimum(np.searchsorted(shared, r.d), len(shared) - 1)] == r.d
            out += [(r.doc_id, r.th, a, b) for a, b in _runs(np.sort(r.p[hit]), length)]
    return pd.DataFrame(out, columns=["doc_id", "th", "start", "end"]).astype({"doc_id": "Int64", "th": "Int64", "start": "int64", "end": "int64"})


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, th (hash of the text), ranges: byte ranges (start, end) that go; they may overlap."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    segments = _io.stored(keyed.mapInArrow(partial(_segments, length=length), SEGMENTS), "segments")
    one = [F.first(c).alias(c) for c in ("doc_id", "th", "first", "windows")]  # all of one row
    counted = segments.select("name", "kind", "doc_id", "th", "first", "windows", (F.size("more") + 1).alias("n"))
    kinds = _io.stored(counted.groupBy("name", "kind").agg(F.sum("n").alias("n"), *one), "kinds")
    _io.release(spark)
    found = segments.join(kinds.where("n > 1").select("name", "kind"), ["name", "kind"], "left_semi").select("slice", F.struct("doc_id", "th", "first", "windows", "more").alias("f"))
    whole = found.groupBy("slice").agg(F.collect_list("f").alias("found"))  # no more than the slice's own segments
    whole = _io.stored(whole.select("found").mapInArrow(partial(_whole, length=length), "doc_id long, th long, ranges array<struct<start:long,end:long>>"), "whole")
    _io.drop_stored(segments)
    _io.release(spark)
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(names, "name")
    total = wanted.agg(F.count("*")).first()[0]
    shards = max(1, -(-total // SHARD_KINDS))
    split = F.ceil(F.col("kinds") / SHARD_KINDS)
    spot = F.when(split > 1, F.xxhash64("name", F.pmod(F.xxhash64("kind"), split))).otherwise(F.pmod(F.xxhash64("name"), F.lit(shards)))
    wanted = wanted.select("doc_id", "th", F.struct(spot.alias("shard"), "name", split.cast("long").alias("split"), "first", "windows", "n").alias("w"))
    per_doc = wanted.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("th2")).agg(F.collect_list("w").alias("wanted"))
    texts = keyed.join(per_doc, keyed.doc_id.eqNullSafe(per_doc.id) & (keyed.th == per_doc.th2)).select("doc_id", "th", "text", "wanted")
    cut = texts.mapInArrow(partial(_cut, length=length), "shard long, name long, split long, doc_id long, th long, first long, windows long, n long, bytes binary")
    made = cut.repartition(max(1, min(shards, 1 << 15)), "shard").sortWithinPartitions("shard", "name").mapInArrow(partial(_shards, length=length), "doc_id long, th long, start long, end long, name long, range long, shard long, single boolean, digests binary, places binary")
    made = _io.stored(made, "shards")
    _io.drop_stored(kinds)
    _io.release(spark)
    ranges = made.where("name is null").select("doc_id", "th", "start", "end")
    merged = made.where("name is not null").select("doc_id", "th", "name", "range", "shard", "single", "digests", "places").groupBy("name", "range").applyInPandas(lambda key, lists: _merge(key, lists, length), "doc_id long, th long, start long, end long")
    ranges = ranges.unionByName(merged).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    out = _io.stored(whole.unionByName(ranges).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    _io.drop_stored(whole)
    _io.drop_stored(made)
    _io.release(spark)
    return out


def merged_ranges(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in sorted(ranges, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["start"], r["end"]))
    return out


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edge = [0, *(x for r in gone for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in _text.text_slices(batches):
        raw, out = data.tobytes(), []
        for i, ranges in enumerate(rows.column(rows.num_columns - 1).to_pylist()):
            gone = merged_ranges(ranges or [])
            out.append((int(offs[i + 1] - offs[i]), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(raw[offs[i] : offs[i + 1]], gone)).hexdigest()))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in _text.text_slices(batches):
        raw = data.tobytes()
        texts: list[str | None] = []
        null = rows.column("text").is_null().to_pylist()
        for i, ranges in enumerate(rows.column(rows.num_columns - 1).to_pylist()):
            if null[i]:
                texts.append(None)
                continue
            body = raw[offs[i] : offs[i + 1]]
            texts.append(_kept(body, merged_ranges(ranges)).decode("utf-8", "ignore") if ranges else body.decode("utf-8"))
        names = rows.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in names], names=names)


def with_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with one more column, the byte ranges that go (null if none)."""
    name, r_id, r_th = (_io.fresh(docs, n) for n in (RANGES, "__r_id", "__r_th"))
    ranges = repeated_ranges(docs, length).select(F.col("doc_id").alias(r_id), F.col("th").alias(r_th), F.col("ranges").alias(name))
    mine = docs.doc_id.cast("long").eqNullSafe(ranges[r_id]) & (F.xxhash64(docs.text.cast("string")) == ranges[r_th])
    return docs.join(ranges, mine, "left").drop(r_id, r_th)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_ranges(docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without strings of STAGE_LENGTH bytes that repeat (nor halves of characters at their ends); n_chars
    follows the text."""
    out = with_ranges(docs, STAGE_LENGTH).mapInArrow(_strip, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out

"""Jaccard join of documents over word shingles by chosen paths.

A document is the set of its SHINGLE-word shingles (lower-cased, split at white space; a shorter text is one shingle).  Sets that
are equal form one kind; the join is over kinds.

A set is embedded as PLACES minhashes.  A run begins with all kinds in one node; a node picks BRANCH of the places, from a
hash of its path, and a kind goes to the child of the value that it has there.  Runs are repeated until the expected recall is RECALL.  Nodes of at most BUCKET kinds are compared
by brute force: kinds whose minhashes agree in CLOSE of the places go on to an exact check on whole sets.  Larger
nodes split again; after DEPTH levels the rest is compared in blocks, each pair of blocks a task's work, so that a node compares each of its pairs once.  Kinds with similarity
s share s * BRANCH children on average, and a run loses a pair with the probability that this branching dies out (1/16 at 0.8).  All
runs and CLOSE read the same PLACES minhashes: over the binomial number of them that agree, four runs lose at most 5.6e-5 of the pairs with s = 0.8
and CLOSE 2.7e-8 more, a recall of 0.99994.  A pair that several nodes hold counts in the one whose path is smallest.

Defined cases: a null text, or one without words, is in no class but its own; repeated rows and equal texts are copies;
null doc_ids are kept, as null; an empty table gives no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _io, _text

SHINGLE, SIMILARITY = 5, 0.8
PLACES, BRANCH, DEPTH, BUCKET = 128, 2, 4, 4096
#: Share of minhashes that must agree: six standard deviations below SIMILARITY.
CLOSE = SIMILARITY - 6 * (SIMILARITY * (1 - SIMILARITY) / PLACES) ** 0.5
#: Expected share of the pairs with similarity SIMILARITY that all runs together find, at least.
RECALL = 0.9999
U64 = np.uint64
_FACTORS = _text.mix64(np.arange(1, PLACES + 1, dtype=U64) * U64(_text.BASE)) | U64(1)


def expected_recall(runs: int, similarity: float = SIMILARITY) -> float:
    """Share of pairs of a similarity that some run finds and CLOSE lets pass, over the minhashes that agree."""
    need, found = math.ceil(CLOSE * PLACES), 0.0
    for agree in range(need, PLACES + 1):
        s = agree / PLACES
        lost = min(1.0, ((1 - s) / s) ** 2)  # the least solution of q = (1 - s + s * q) ** BRANCH for two branches
        found += math.comb(PLACES, agree) * similarity**agree * (1 - similarity) ** (PLACES - agree) * (1 - lost**runs)
    return found


def runs_for(recall: float) -> int:
    """The fewest runs whose expected recall is `recall`."""
    runs = 1
    while expected_recall(runs) < recall:
        runs += 1
    return runs


RUNS = runs_for(RECALL)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, cuts): each text's shingle hashes in order, without repeats."""
    docs = len(offs) - 1
    starts, ends, doc = _text.words(data, offs)
    h = _text.word_hashes(_text.LOWER[data], starts, ends)
    key = h
    n = np.bincount(doc, minlength=docs)
    first = np.cumsum(n) - n
    values, owner = [], []
    if len(h) >= SHINGLE:
        key = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            key = key * U64(_text.BASE) + h[k : len(h) - SHINGLE + 1 + k]
        inside = doc[SHINGLE - 1 :] == doc[: len(h) - SHINGLE + 1]
        values.append(_text.mix64(key[inside]))
        owner.append(doc[: len(h) - SHINGLE + 1][inside])
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        whole = U64(int(n[d]))
        for x in h[first[d] : first[d] + n[d]]:
            whole = _text.mix64(np.array([whole ^ x]))[0]
        values.append(np.array([whole], U64))
        owner.append(np.array([d]))
    if not values:
        return np.zeros(0, U64), np.zeros(docs + 1, np.int64)
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    keep = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    return v[keep], np.searchsorted(o[keep], np.arange(docs + 1))


def minhashes(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(sets, PLACES) minhashes of the sets that have a value, in order."""
    starts = cuts[:-1][cuts[1:] > cuts[:-1]]
    out = np.empty((len(starts), PLACES), np.uint32)
    for k in range(PLACES):
        out[:, k] = np.minimum.reduceat((values * _FACTORS[k]) >> U64(32), starts) if len(starts) else 0
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in _text.text_slices(batches):
        values, cuts = shingle_sets(data, offs)
        mins = iter(minhashes(values, cuts))
        some = (cuts[1:] > cuts[:-1]).tolist()
        kind = [xxhash.xxh3_64_intdigest(values[a:b].tobytes()) - (1 << 63) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(kind, pa.int64()), pa.array([next(mins).tobytes() if s else None for s in some], pa.binary())], names=["doc_id", "th", "kind", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in _text.text_slices(batches):
        values, cuts = shingle_sets(data, offs)
        yield pa.RecordBatch.from_arrays([rows.column("kind"), pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["kind", "values"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, PLACES)


def children(path: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
    """The paths to which a row of each (path, sketch) goes on."""
    pick = _text.mix64(path)
    place = (pick % U64(PLACES)).astype(np.int64)
    step = ((pick >> U64(32)) % U64(PLACES - 1)).astype(np.int64) + 1
    out = []
    for b in range(BRANCH):
        where = (place + b * step) % PLACES
        value = sketch[np.arange(len(sketch)), where].astype(U64)
        out.append(_text.mix64(_text.mix64(path * U64(_text.BASE) + where.astype(U64)) + value))
    return out


def _split(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch, kind = _matrix(batch.column("sketch")), batch.column("kind").to_numpy(zero_copy_only=False)
        paths = [np.full(len(kind), r, U64) for r in range(RUNS)] if first else [batch.column("path").to_numpy(zero_copy_only=False).view(U64)]
        new = [c for p in paths for c in children(p, sketch)]
        yield pa.RecordBatch.from_arrays([pa.array(_text.to_i64(np.concatenate(new))), pa.array(np.tile(kind, len(new)))], names=["path", "kind"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with the same key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def close_pairs(sketch: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j whose sketches agree in CLOSE of the places; with sides, only pairs across them."""
    need, left, right = int(np.ceil(CLOSE * PLACES)), [], []
    for i in range(len(sketch) - 1):
        j = np.flatnonzero(np.count_nonzero(sketch[i + 1 :] == sketch[i], axis=1) >= need) + i + 1
        if side is not None:
            j = j[side[j] != side[i]]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


@_text.trimmed
def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force in a bucket: each kind with the kinds after it that look close, of those that no node with a smaller path holds too."""
    for group in _groups(batches, "bucket"):
        group = group.combine_chunks()
        sketch = _matrix(group.column("sketch"))
        kind, mine = group.column("kind").to_numpy(), group.column("bucket")[0].as_py()
        half, node = group.column("side").to_numpy(), group.column("path")[0].as_py()
        i, j = close_pairs(sketch, half if (half >= 0).all() else None)
        smaller = [frozenset(p for p in x if p < node) for x in group.column("paths").to_pylist()]
        fresh = np.fromiter((smaller[a].isdisjoint(smaller[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        i, j = i[fresh], j[fresh]
        if len(i):
            live, inverse = np.unique(np.concatenate((i, j)), return_inverse=True)
            a, b = inverse[: len(i)], inverse[len(i) :]
            by = np.argsort(a, kind="stable")
            parts = np.split(kind[live][b[by]], np.searchsorted(a[by], np.arange(1, len(live))))
            yield pa.RecordBatch.from_arrays([pa.array([mine] * len(live), pa.int64()), pa.array(kind[live]), pa.array(parts, pa.list_(pa.int64()))], names=["bucket", "kind", "close"])


@_text.trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of close kinds of a bucket: each kind's links there, and the least kind that it is joined with."""
    for group in _groups(batches, "bucket"):
        group = group.combine_chunks()
        kind, copies = group.column("kind").to_numpy(), group.column("copies").to_numpy()
        by = np.argsort(kind)
        sets = [np.frombuffer(v, U64) for v in group.column("values").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        base = np.cumsum(size) - size
        every, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark, links = np.zeros(len(every), bool), [[] for _ in kind]
        for i, close in enumerate(group.column("close").to_pylist()):
            if not close:
                continue
            j = by[np.searchsorted(kind[by], np.array(close))]
            own = flat[base[i] : base[i] + size[i]]
            mark[own] = True
            n = size[j]
            at = np.repeat(base[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            for k in j[both >= SIMILARITY * (size[i] + n - both) - 1e-9].tolist():
                links[i].append(k)
                links[k].append(i)
        root = np.full(len(kind), -1)
        for s in by.tolist():
            if root[s] < 0 and links[s]:
                todo = [s]
                while todo:
                    x = todo.pop()
                    if root[x] < 0:
                        root[x] = s
                        todo += links[x]
        live = [i for i in range(len(kind)) if links[i]]
        if live:
            yield pa.RecordBatch.from_arrays([pa.array(kind[live]), pa.array(kind[root[live]]), pa.array([int(copies[links[i]].sum()) for i in live], pa.int64()), pa.array([kind[links[i]] for i in live], pa.list_(pa.int64()))], names=["kind", "root", "n_links", "linked"])


def _blocked(rows: DataFrame, size: DataFrame) -> DataFrame:
    """Rows (path, kind) of nodes too large for a bucket, dealt to a bucket for each pair of blocks.

    Kinds of one block share all of its buckets but meet only in its own, so pairs are told apart by node and not by bucket."""
    blocks = F.ceil(F.col("n") / (BUCKET // 2)).cast("int")
    mine = F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int")
    dealt = rows.join(size, "path").withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return dealt.select("path", "kind", F.xxhash64("path", low, high).alias("bucket"), side.alias("side"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, kinds, found): doc_id and kind of each row; kind, copies and least of each kind; and for each kind and
    bucket with a link: kind, root (a kind it is joined with), n_links (documents), linked (kinds)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    drawn = _io.stored(keyed.mapInArrow(_sketch, "doc_id long, th long, kind long, sketch binary"), "sketches")
    members = _io.stored(drawn.select("doc_id", "th", "kind"), "members")
    has = drawn.where("kind is not null")
    kinds = _io.stored(has.groupBy("kind").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one")), "kinds")
    sketches = _io.stored(has.select("kind", "sketch").dropDuplicates(["kind"]), "kind-sketches")
    _io.drop_stored(drawn)
    _io.release(docs.sparkSession)
    paths, leaves, used = sketches.mapInArrow(partial(_split, first=True), "path long, kind long"), [], []
    for depth in range(DEPTH):
        paths = _io.stored(paths, "paths")
        size = _io.stored(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        leaves.append(paths.join(size.where(F.col("n") <= BUCKET).select("path"), "path").select("path", "kind", F.col("path").alias("bucket"), F.lit(-1).alias("side")))
        used += [paths, size]
        big = size.where(F.col("n") > BUCKET)
        if big.isEmpty():
            break
        rows = paths.join(big.select("path"), "path")
        if depth == DEPTH - 1:
            leaves.append(_blocked(rows, big))
        else:
            paths = rows.join(sketches, "kind").select("path", "kind", "sketch").mapInArrow(partial(_split, first=False), "path long, kind long").distinct()
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    leaf = _io.stored(leaf, "leaves")
    for x in used:
        _io.drop_stored(x)
    every = leaf.groupBy("kind").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    full = leaf.select("kind", "path", "bucket", "side").join(every, "kind").join(sketches, "kind")
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    near = _io.stored(full.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_candidates, "bucket long, kind long, close array<long>"), "near")
    _io.drop_stored(leaf)
    _io.drop_stored(sketches)
    _io.release(spark)
    live = near.select("kind").distinct().join(kinds, "kind").select("kind", F.col("one.doc_id").alias("l_id"), F.col("one.th").alias("l_th"))
    texts = keyed.join(live, keyed.doc_id.eqNullSafe(live.l_id) & (keyed.th == live.l_th)).select("kind", "text")
    sets = _io.stored(texts.mapInArrow(_sets, "kind long, values binary").dropDuplicates(["kind"]).join(kinds.select("kind", "copies"), "kind"), "sets")
    _io.release(spark)
    checked = near.join(sets, "kind").repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_verify, "kind long, root long, n_links long, linked array<long>")
    found = _io.stored(checked, "links")
    _io.drop_stored(sets)
    _io.drop_stored(near)
    return members, kinds, found


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node joined with it) for edges (a, b), by minimum labels and pointer jumping."""
    both = _io.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    kept = labels = _io.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels.node == seen.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        near = _io.stored(near, "near-labels")
        up = near.select(F.col("node").alias("up"), F.col("label").alias("far"))
        new = _io.stored(near.join(up, near.label == up.up, "left").select("node", F.least("label", "far").alias("label"), "was"), "labels")
        done = new.where("label <> was").isEmpty()
        _io.drop_stored(near)
        _io.drop_stored(kept)
        kept, labels = new, new.select("node", "label")
        if done:
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class of linked documents), n_links (documents with a
    similarity of SIMILARITY or more, copies included), copy_id (least doc_id with the same shingles), kind."""
    members, kinds, found = links(docs)
    joined = components(found.select(F.col("kind").alias("a"), F.col("root").alias("b")))
    total = found.groupBy(F.col("kind").alias("k2")).agg(F.sum("n_links").alias("linked"))
    per_kind = kinds.join(joined, kinds.kind == joined.node, "left").join(total, kinds.kind == total.k2, "left")
    per_kind = _io.stored(per_kind.select("kind", "copies", "least", F.coalesce("label", "kind").alias("label"), F.coalesce("linked", F.lit(0)).alias("linked")), "kind-links")
    least = per_kind.groupBy("label").agg(F.min("least").alias("class_id"))
    per_kind = per_kind.join(least, "label").select("kind", "class_id", F.col("least").alias("copy_id"), (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    out = members.select("doc_id", "th", "kind").join(per_kind, "kind", "left")
    return out.select("doc_id", "th", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(_io.table(spark, sf_dir, "documents")).drop("th")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the least doc_id, with all columns; of rows that repeat it, one."""
    found = _io.stored(classes(docs), "classes")
    x_id, x_th, many = (_io.fresh(docs, n) for n in ("__x_id", "__x_th", "__many"))
    key = docs.doc_id.cast("long"), F.xxhash64(docs.text.cast("string"))
    same = lambda x: key[0].eqNullSafe(x[x_id]) & key[1].eqNullSafe(x[x_th])
    named = found.select(F.col("doc_id").alias(x_id), F.col("th").alias(x_th), "class_id")
    extra = named.where(~F.col(x_id).eqNullSafe(F.col("class_id"))).select(x_id, x_th).distinct()
    again = named.where(F.col(x_id).eqNullSafe(F.col("class_id"))).groupBy(x_id, x_th).agg(F.count("*").alias(many)).where(F.col(many) > 1)
    if again.isEmpty():
        return docs.join(extra, same(extra), "left_anti")
    gone = extra.unionByName(again.select(x_id, x_th))
    return docs.join(gone, same(gone), "left_anti").unionByName(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))

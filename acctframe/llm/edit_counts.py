"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only what it touches.

A document's units (see _bpe) are gathered in leaves of about LEAF units.  Every leaf but the first begins with a space that a
non-space follows, where a pre-token starts whatever stands on the left, so a leaf's ids depend on its own bytes only.
Inner nodes hold the sums of bytes and tokens below.  build() makes a table of texts with the bytes and tokens of their leaves, which
is kept; apply_edits() reads it and tokenises nothing but regions: an edit finds its leaves by the byte sums, takes the leaf before as
context where it touches a leaf's first two bytes, re-encodes that region, and updates the sums on the paths to the root.  The
first edits of all documents of a slice are encoded together, then the second ones, and so on.

Defined cases: a null or empty text has no tokens, and edits of it are insertions at its start; edits beyond the text's end are
applied at its end, and edits inside a character begin before it; null doc_ids and repeated rows are counted like others, and edits of a
doc_id go to each of its rows; an empty table gives no row; other columns are not read, whatever their names.  Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _bpe, _io, _text

LEAF, SLICE = 32, 1 << 21


def leaf_heads(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which units of a text begin a leaf: the first one, and of those that begin with a space each LEAF-th."""
    if not len(starts):
        return np.zeros(0, np.int64)
    spaced = np.flatnonzero(data[starts] == 32)
    return np.unique(np.concatenate(([0], spaced[LEAF - 1 :: LEAF])))


class Tree:
    """Byte and token sums over the leaves of one text."""

    def __init__(self, raw: bytes, leaf_bytes: np.ndarray, leaf_tokens: np.ndarray):
        ends = np.cumsum(leaf_bytes)
        self.leaves = [raw[a:b] for a, b in zip((ends - leaf_bytes).tolist(), ends.tolist(), strict=True)] or [b""]
        self.encoded = 0
        self._sum(leaf_bytes, leaf_tokens)

    def _sum(self, leaf_bytes: np.ndarray, leaf_tokens: np.ndarray) -> None:
        self.size = half = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.bytes, self.tokens = np.zeros(2 * half, np.int64), np.zeros(2 * half, np.int64)
        self.bytes[half : half + len(leaf_bytes)] = leaf_bytes
        self.tokens[half : half + len(leaf_tokens)] = leaf_tokens
        while half > 1:
            for x in (self.bytes, self.tokens):
                x[half // 2 : half] = x[half : 2 * half].reshape(-1, 2).sum(axis=1)
            half //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def of_leaves(self, sums: np.ndarray) -> np.ndarray:
        return sums[self.size : self.size + len(self.leaves)]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds the byte at a place, place of that leaf's first byte)."""
        node, before = (1, 0) if self.bytes[1] else (self.size, 0)
        while node < self.size:
            node *= 2
            if at >= before + self.bytes[node]:
                before += int(self.bytes[node])
                node += 1
        return node - self.size, before

    def _put(self, leaf: int, raw: bytes, tokens: int) -> None:
        self.leaves[leaf] = raw
        node = leaf + self.size
        more, extra = len(raw) - int(self.bytes[node]), tokens - int(self.tokens[node])
        while node:
            self.bytes[node] += more
            self.tokens[node] += extra
            node //= 2

    def touched(self, start: int, end: int, new: bytes) -> tuple[int, int, bytes]:
        """(first leaf, last leaf, their bytes once the bytes from start to end are replaced by new)."""
        length = int(self.bytes[1])
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, first_at = self.find(min(start, max(length - 1, 0)))
        last, _ = self.find(max(start, end - 1)) if end > start else (first, first_at)
        while first > 0 and start <= first_at + 1:
            first -= 1
            first_at -= len(self.leaves[first])
            if len(self.leaves[first]) > 1:
                break
        region = b"".join(self.leaves[first : last + 1])
        # an edit inside a character begins before it and takes it whole
        a, b = start - first_at, end - first_at
        while 0 < a < len(region) and region[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(region) and b > 0 and region[b] & 0xC0 == 0x80:
            b += 1
        return first, last, region[:a] + new + region[max(b, a) :]

    def replace(self, first: int, last: int, region: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Puts a region, whose units and their sizes are given, in the place of leaves."""
        self.encoded += len(region)
        heads = leaf_heads(np.frombuffer(region, np.uint8), starts)
        cuts = [*starts[heads].tolist(), len(region)]
        parts = [region[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [b""]
        tokens = np.add.reduceat(sizes, heads).tolist() if len(heads) else [0]
        parts += [b""] * (last + 1 - first - len(parts))
        tokens += [0] * (len(parts) - len(tokens))
        if len(parts) == last + 1 - first:
            for k, (raw, n) in enumerate(zip(parts, tokens, strict=True)):
                self._put(first + k, raw, n)
        else:
            sums = [np.concatenate((s[:first], new, s[last + 1 :])) for s, new in ((self.of_leaves(self.bytes), [len(p) for p in parts]), (self.of_leaves(self.tokens), tokens))]
            self.leaves[first : last + 1] = parts
            self._sum(*sums)

    def text(self) -> bytes:
        return b"".join(self.leaves)


def plant(enc: _bpe.Encoder, raw: bytes) -> Tree:
    """The tree of a text that has none yet."""
    data = np.frombuffer(raw, np.uint8)
    starts, sizes = enc.sizes(data, np.array([0, len(data)]))
    heads = leaf_heads(data, starts)
    return Tree(raw, np.diff(np.append(starts[heads], len(raw))) if len(heads) else heads, np.add.reduceat(sizes, heads) if len(heads) else heads)


def edit_all(enc: _bpe.Encoder, trees: list[Tree], edits: list[list[tuple[int, int, bytes]]]) -> None:
    """Applies each tree's edits in turn; the k-th edits of all trees are encoded together."""
    for k in range(max(map(len, edits), default=0)):
        who = [i for i, e in enumerate(edits) if len(e) > k]
        regions = [trees[i].touched(*edits[i][k]) for i in who]
        offs = np.concatenate(([0], np.cumsum([len(r[2]) for r in regions])))
        starts, sizes = enc.sizes(np.frombuffer(b"".join(r[2] for r in regions), np.uint8), offs)
        cuts = np.searchsorted(starts, offs).tolist()
        for i, (first, last, region), at, a, b in zip(who, regions, offs[:-1].tolist(), cuts[:-1], cuts[1:], strict=True):
            trees[i].replace(first, last, region, starts[a:b] - at, sizes[a:b])


TREES = "doc_id long, text string, leaf_bytes array<int>, leaf_tokens array<int>"


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = _bpe.encoder(path)
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        starts, sizes = enc.sizes(data, offs)
        cuts = np.searchsorted(starts, offs).tolist()
        each = [a + leaf_heads(data, starts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        heads = np.concatenate(each)
        at = starts[heads] if len(heads) else heads
        lists = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        ends = np.append(at[1:], len(data)) if len(at) else at
        leaf_bytes, leaf_tokens = (ends - at).astype(np.int32), (np.add.reduceat(sizes, heads) if len(heads) else heads).astype(np.int32)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), *(pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (leaf_bytes, leaf_tokens))], names=["doc_id", "text", "leaf_bytes", "leaf_tokens"])


def build(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text, and the bytes and tokens of the leaves of each text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_build, path=vocabulary), TREES)


OUT = ["n_tokens", "n_edits", "edited_tokens", "edited_bytes", "encoded_bytes"]


def _apply(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    enc = _bpe.encoder(path)
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        raw, trees = data.tobytes(), []
        lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (rows.column("leaf_bytes"), rows.column("leaf_tokens"))]
        for i in range(rows.num_rows):
            trees.append(Tree(raw[offs[i] : offs[i + 1]], *(v[o[i] : o[i + 1]] for o, v in lists)))
        edits = [[(e["start"], e["end"], (e["new"] or "").encode()) for e in each or []] for each in rows.column("edits").to_pylist()]
        before = [t.total for t in trees]
        edit_all(enc, trees, edits)
        numbers = [before, [len(e) for e in edits], [t.total for t in trees], [int(t.bytes[1]) for t in trees], [t.encoded for t in trees]]
        cols, names = [rows.column("doc_id"), *(pa.array(n, pa.int64()) for n in numbers)], ["doc_id", *OUT]
        if keep:
            cols += [pa.array([t.text() for t in trees], pa.binary()).cast(pa.string()), *(pa.array([t.of_leaves(s).tolist() for t, s in zip(trees, sums, strict=True)], pa.list_(pa.int32())) for sums in ([t.bytes for t in trees], [t.tokens for t in trees]))]
            names += ["text", "leaf_bytes", "leaf_tokens"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def apply_edits(trees: DataFrame, vocabulary: str, keep: bool = True) -> DataFrame:
    """Counts of each row of a table of trees with a column edits (structs of start, end, new; places in bytes of the text as the edits
    before have left it): doc_id and OUT, and with keep the text and leaves that follow, for the next edits."""
    kind = "doc_id long, " + ", ".join(f"{n} long" for n in OUT) + (", text string, leaf_bytes array<int>, leaf_tokens array<int>" if keep else "")
    return trees.select("doc_id", "text", "leaf_bytes", "leaf_tokens", "edits").mapInArrow(partial(_apply, path=vocabulary, keep=keep), kind)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits (doc_id, seq, start, end, new) of their document, in order of seq; null where there are none."""
    listed = edits.groupBy(F.col("doc_id").cast("long").alias("e_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("edits"))
    return trees.join(listed, trees.doc_id.eqNullSafe(listed.e_id), "left").drop("e_id")


def counts(docs: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """Counts of each text before and after its edits, from trees that are stored first."""
    return apply_edits(with_edits(_io.stored(build(docs, vocabulary), "trees"), edits), vocabulary, keep=False)


def sample_edits(length):
    """The query's edits of a text of so many bytes: an insertion at a quarter, a deletion at half, a replacement at the end."""
    quarter, half = F.floor(length / 4), F.floor(length / 2)
    each = [(quarter, quarter, " inserted, here"), (half, half + 24, ""), (length - 8, length, " end.")]
    return F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("new")) for a, b, new in each])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the trees of all documents, then applies three edits to each."""
    vocabulary = _bpe.default_vocabulary()
    trees = _io.stored(build(_io.table(spark, sf_dir, "documents"), vocabulary), "trees")
    return apply_edits(trees.withColumn("edits", sample_edits(F.coalesce(F.octet_length("text"), F.lit(0)))), vocabulary, keep=False)

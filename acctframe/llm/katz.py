"""Katz backoff language model: Good-Turing discounted 1-, 2- and 3-gram counts, exactly normalised, in partitioned tables.

Tokens are the words of the lower-cased text and then one end; ends stand before a first word.  With c the training
counts, d the Good-Turing discounts of an order (counts up to CUT), and D a history's count (one more where nothing was discounted):

    P(w | u v) = d(c(u, v, w)) * c(u, v, w) / D(u, v)   if c(u, v, w) >= KEPT, else  alpha(u, v) * P(w | v)
    P(w | v)   = d(c(v, w)) * c(v, w) / D(v)            if c(v, w) > 0, else         alpha(v) * P(w)
    P(w)       = d(c(w)) * c(w) / D                     if c(w) > 0, else the mass left over, given to one unknown word

alpha makes each history's sum 1; it is 1 for a history without kept followers.  A token is evaluated from the triple down: its bucket of
triples adds log P(w | u v) - log P(w | v), or log alpha(u, v), to what its bucket of pairs gives, which adds log alpha(v) to the word's.

Words are 63-bit hashes.  Words from a count threshold on, VOCABULARY of them at most, have numbers and their statistics are
broadcast; that bounds the broadcast only: the rest is counted and scored alike, through joins on the word.  Pairs and triples travel as sorted,
packed blocks, one per slice of text and bucket, and are counted in one shuffle.  Those of a history meet in one task; those of the
commonest histories are dealt over all buckets (SPREAD, HOT).  The pairs' probabilities under kept triples are fetched once, from bucket to
bucket, as the model is fitted.  Documents are scored by pairs in buckets, sums by slice, rare words by join, then by triples in buckets.

Defined cases: a null or empty text is its end token; a null doc_id counts as training; repeated rows count and score each for
itself; without training text every token is the unknown word, of probability 1; an empty table gives no row; other columns are
not read, whatever their names.  All texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.llm import _io, _text

CUT = 5
ORDER = 3
#: Words with numbers, at most; three numbers are to fit in one of 64 bits.
VOCABULARY = 1 << 19
#: Histories with a number below this have their pairs dealt over all buckets.
SPREAD = 4096
SLICE, BUCKET_BYTES, ROWS = 2 << 20, 4 << 20, 50_000
U64, TOP = np.uint64, np.uint64(1 << 63)
END = np.uint64(0xE3D0000000000001)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with ends, document index) of all tokens."""
    starts, ends, doc = _text.words(data, offs)
    h = _text.word_hashes(_text.LOWER[data], starts, ends) | TOP
    docs = len(offs) - 1
    n = np.bincount(doc, minlength=docs)
    out = np.full(len(h) + docs, END, U64)
    out[np.arange(len(h)) + doc] = h
    return out, np.repeat(np.arange(docs), n + 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 64-bit numbers as planes of the bytes that they need, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, U64) if a.dtype == U64 else a.astype(U64)
        planes = -(-int(a.max()).bit_length() // 8) if len(a) else 0
        out.append(len(a).to_bytes(8, "little") + bytes([planes]))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())
    return _packer().compress(b"".join(out))


def unpack(raw: bytes) -> list[np.ndarray]:
    data, at, out = _unpacker().decompress(raw), 0, []
    while at < len(data):
        n, planes = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        a = np.zeros((n, 8), np.uint8)
        a[:, :planes] = np.frombuffer(data, np.uint8, planes * n, at + 9).reshape(planes, n).T
        out.append(a.view(U64).ravel())
        at += 9 + planes * n
    return out


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U64(0))


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=U64)


class Vocabulary:
    """Numbered words: hashes in order of falling count, and statistics by number."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order]
        self.number = np.argsort(self.words)
        self.sorted = self.words[self.number]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of numbered words; the others' hashes, which have the top bit."""
        if not len(self.sorted):
            return words
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.number[at].astype(U64), words)


def bucket_of(h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    return (_text.mix64(np.where(h < SPREAD, h * U64(_text.BASE) + w, h)) % U64(buckets)).astype(np.int64)


#: Distinct words of slices that are gathered before they are handed on.
GATHERED = 1 << 20


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        w, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(w)
        first = _firsts(w[order])
        return pa.RecordBatch.from_arrays([pa.array(_text.to_i64(w[order][first])), pa.array(np.add.reduceat(n[order], first))], names=["w", "c"])

    for _, data, offs in _text.text_slices(batches, most=SLICE):
        held.append(np.unique(tokens(data, offs)[0], return_counts=True))
        if sum(len(w) for w, _ in held) >= GATHERED:
            yield merged()
            held = []
    if held:
        yield merged()


class Slice:
    """The tokens of a slice as ranks among its distinct words, whose codes are in order; words are looked up once each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary):
        words, self.doc = tokens(data, offs)
        distinct, which = np.unique(np.append(words, END), return_inverse=True)
        codes = vocabulary.codes(distinct)
        by = np.argsort(codes)
        rank = np.empty(len(codes), U64)
        rank[by] = np.arange(len(codes), dtype=U64)
        which = rank[which]
        self.codes, self.w, self.end = codes[by], which[:-1], which[-1]
        self.v = np.concatenate((which[-1:], which[:-2]))
        # an end stands before a first word, and another before that
        self.u = np.where(self.v == self.end, self.end, np.concatenate((which[-1:], which[-1:], which[:-3]))[: len(self.v)])
        self.bits = U64(max(1, len(codes).bit_length()))
        self.code = self.codes[self.w]

    def _order(self, bucket: np.ndarray, buckets: int, *ranks: np.ndarray) -> np.ndarray:
        if buckets.bit_length() + len(ranks) * int(self.bits) > 64:
            return np.lexsort((*ranks[::-1], bucket))
        key = bucket.astype(U64)
        for r in ranks:
            key = key << self.bits | r
        return np.argsort(key)

    def pairs(self, buckets: int):
        """Sorted pairs: (bucket, history, word, document)."""
        before = self.codes[self.v]
        bucket = bucket_of(before, self.code, buckets)
        order = self._order(bucket, buckets, self.v, self.w)
        return bucket[order], before[order], self.code[order], self.doc[order]

    def triples(self, buckets: int):
        """Sorted triples: (bucket, first and second word of the history, word, document)."""
        u, v = self.codes[self.u], self.codes[self.v]
        bucket = triple_bucket(u, v, self.code, buckets)
        order = self._order(bucket, buckets, self.u, self.v, self.w)
        return bucket[order], u[order], v[order], self.code[order], self.doc[order]


#: Histories of two words with numbers below this have their triples dealt over all buckets, and their statistics broadcast.
HOT = 128
#: Triples seen at least so often are kept; what the others had goes to the shorter history, as is common for third-order counts.
KEPT = 2
WORD_BITS = U64(20)


def history_id(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One number for a history of two words: both words' numbers, or a hash with the top bit."""
    return np.where((u < TOP) & (v < TOP), u << WORD_BITS | v, _pair_key(u, v) | TOP)


def triple_bucket(u: np.ndarray, v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    h = history_id(u, v)
    hot = (u < HOT) & (v < HOT)
    return (_text.mix64(np.where(hot, h * U64(_text.BASE) + w, h) + U64(3)) % U64(buckets)).astype(np.int64)


#: Pairs of numbered words are one number each.
PAIR_BITS = U64(32)


def _numbered(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (h < TOP) & (w < TOP)


def _in_order(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order in which equal pairs stand together, those of numbered words first and by history and word."""
    both = _numbered(h, w)
    first, rest = np.flatnonzero(both), np.flatnonzero(~both)
    first = first[np.argsort(h[first] << PAIR_BITS | w[first], kind="stable")]  # runs that are sorted already are merged
    return np.concatenate((first, rest[np.lexsort((w[rest], h[rest]))]))


class Counts:
    """The counts of a bucket's pairs, as _in_order has them."""

    def __init__(self, h: np.ndarray, w: np.ndarray, c: np.ndarray):
        n = int(_numbered(h, w).sum())
        self.numbered, self.numbered_counts = h[:n] << PAIR_BITS | w[:n], c[:n].astype(np.int64)
        keys = _pair_key(h[n:], w[n:])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], c[n:][order].astype(np.int64)
        self.rare = h[n:][h[n:] >= TOP], c[n:][h[n:] >= TOP].astype(np.int64)

    def weigh(self, discounts: np.ndarray) -> None:
        """Makes D of the histories without a number, which have all their pairs here."""
        h, c = self.rare
        self.ids, which = np.unique(h, return_inverse=True)
        lost = np.bincount(which, weights=(c * (1 - discounts[np.minimum(c, CUT + 1)])), minlength=len(self.ids))
        self.sizes = np.bincount(which, weights=c, minlength=len(self.ids)) + (lost == 0)

    def size(self, h: np.ndarray) -> np.ndarray:
        return self.sizes[np.searchsorted(self.ids, h)]

    @staticmethod
    def _find(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, counts[at], 0)

    def of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        both, out = _numbered(h, w), np.zeros(len(h), np.int64)
        out[both] = self._find(self.numbered, self.numbered_counts, h[both] << PAIR_BITS | w[both])
        out[~both] = self._find(self.keys, self.counts, _pair_key(h[~both], w[~both]))
        return out


NO_COUNTS = np.zeros(0, U64)


def _firsts(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _blocks(kind: str, bucket: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """The distinct rows of sorted columns with their numbers, packed by bucket."""
    first = _firsts(bucket, *cols)
    n = np.diff(np.append(first, len(bucket)))
    bucket, cols = bucket[first], [c[first] for c in cols]
    cuts = [*_firsts(bucket).tolist(), len(bucket)]
    packed = [pack(delta(cols[0][a:b]), *(c[a:b] for c in cols[1:]), n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([kind] * len(packed), pa.string()), pa.array(packed, pa.binary())], names=["bucket", "kind", "block"])


def _count_blocks(batches: Iterator[pa.RecordBatch], vocabulary, buckets: int, order: int) -> Iterator[pa.RecordBatch]:
    for _, data, offs in _text.text_slices(batches, most=SLICE):
        part = Slice(data, offs, vocabulary.value)
        yield _blocks("pairs", *part.pairs(buckets)[:-1])
        if order > 2:
            yield _blocks("triples", *part.triples(buckets)[:-1])


LOW = [f"m{r}" for r in range(1, CUT + 2)]
COUNTED = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.binary()), ("h", pa.int64()), ("w", pa.int64()), *((m, pa.int64()) for m in LOW), ("p", pa.float64()), ("c", pa.int64())])
COUNTED_DDL = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary', pa.float64(): 'double'})[f.type]}" for f in COUNTED)


def _batch(n: int, **cols) -> pa.RecordBatch:
    """n rows of COUNTED with these columns; the others are null."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in COUNTED], schema=COUNTED)


@_text.trimmed
def _count(batches: Iterator[pa.RecordBatch], vocabulary, p1) -> Iterator[pa.RecordBatch]:
    """Counts of a bucket's pairs ('pairs', with how many have each low count), histories' sums ('history'), and the
    pairs whose word has no number ('rare'); then of its triples ('triples'), and sums of hot histories ('hot')."""
    voc, held, now = vocabulary.value, [], (None, None)

    def done(blocks: list[bytes]):
        parts = [unpack(b) for b in blocks]
        h, w, n = (np.concatenate([undelta(x[0]) for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts]))
        del parts
        order = _in_order(h, w)
        h, w, n = h[order], w[order], n[order].astype(np.int64)
        del order
        first = _firsts(h, w)
        c, h, w = np.add.reduceat(n, first), h[first], w[first]
        del n, first
        yield _batch(1, kind=["pairs"], bucket=[now[0]], block=[pack(delta(h), w, c)], **{m: [int((c == r + 1).sum())] for r, m in enumerate(LOW)})
        head = _firsts(h)
        numbered = w < TOP
        known = np.zeros(len(w))
        known[numbered] = p1.value[w[numbered].astype(np.int64)]
        hs = h[head].copy()
        inner = hs < TOP
        hs[inner] = voc.words[hs[inner].astype(np.int64)]
        sums = {m: np.add.reduceat((c == r + 1).astype(np.int64), head) for r, m in enumerate(LOW)} | {"p": np.add.reduceat(known, head), "h": _text.to_i64(hs)}
        for a in range(0, len(head), ROWS):
            part = {k: v[a : a + ROWS] for k, v in sums.items()}
            yield _batch(len(part["h"]), kind=["history"] * len(part["h"]), **part)
        rare = np.flatnonzero(~numbered)
        of = hs[np.searchsorted(head, rare, "right") - 1]
        for a in range(0, len(rare), ROWS):
            k = rare[a : a + ROWS]
            yield _batch(len(k), kind=["rare"] * len(k), h=_text.to_i64(of[a : a + ROWS]), w=_text.to_i64(w[k]))

    for batch in batches:
        for bucket, kind, block in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if held and (bucket, kind) != now:
                yield from done(held) if now[1] == "pairs" else _count_triples(now[0], held)
                held = []
            now = bucket, kind
            held.append(block)
    if held:
        yield from done(held) if now[1] == "pairs" else _count_triples(now[0], held)


def _triple_order(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order in which equal triples stand together: those of numbered words first."""
    whole = (u < TOP) & (v < TOP) & (w < TOP)
    first, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
    first = first[np.argsort((u[first] << WORD_BITS | v[first]) << WORD_BITS | w[first], kind="stable")]
    return np.concatenate((first, rest[np.lexsort((w[rest], v[rest], u[rest]))]))


def _sums(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids, and sums of whole numbers by them."""
    distinct, which = np.unique(ids, return_inverse=True)
    return distinct, [np.bincount(which, weights=x, minlength=len(distinct)).astype(np.int64) for x in values]


def _count_triples(bucket: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The triples of a bucket that are kept, and of each history with one the count and how many have each low count."""
    parts = [unpack(b) for b in blocks]
    u, v, w, n = (np.concatenate([undelta(x[k]) if not k else x[k] for x in parts]) for k in range(4))
    del parts
    order = _triple_order(u, v, w)
    u, v, w, n = u[order], v[order], w[order], n[order].astype(np.int64)
    first = _firsts(u, v, w)
    c, u, v, w = np.add.reduceat(n, first), u[first], v[first], w[first]
    del n, first, order
    low = {m: [int((c == r + 1).sum())] for r, m in enumerate(LOW)}
    ids, hot = history_id(u, v), (u < HOT) & (v < HOT)
    if hot.any():
        hs, sums = _sums(ids[hot], c[hot], *((c[hot] == r + 1) for r in range(CUT + 1)))
        yield _batch(len(hs), kind=["hot"] * len(hs), h=_text.to_i64(hs), c=sums[0], **dict(zip(LOW, sums[1:], strict=True)))
    keep = c >= KEPT
    mine = np.isin(ids, ids[keep & ~hot]) & ~hot
    hs, sums = _sums(ids[mine], c[mine], *((c[mine] == r) for r in range(1, CUT + 1)))
    yield _batch(1, kind=["triples"], bucket=[bucket], block=[pack(u[keep], v[keep], w[keep], c[keep], delta(hs), *sums)], **low)


def discounts(low: list[int]) -> np.ndarray:
    """d(0..CUT), then 1 for all higher counts, from the numbers of types seen 1 .. CUT + 1 times; 1 where the formula gives none between 0 and 1."""
    d = np.ones(CUT + 2)
    common = (CUT + 1) * low[CUT] / low[0] if low[0] else 1.0
    for r in range(1, CUT + 1):
        if low[r - 1] and common < 1:
            value = ((r + 1) * low[r] / (r * low[r - 1]) - common) / (1 - common)
            d[r] = value if 0 < value < 1 else 1.0
    return d


def discount_column(count, d: np.ndarray):
    """The discount of a count column."""
    out = F.lit(1.0)
    for r in range(1, CUT + 1):
        out = F.when(count == r, float(d[r])).otherwise(out)
    return out


class Model:
    """words: w, c, d_log (log10 of D), a_log (log10 of alpha), p_log (log10 of P(w)); pairs: packed counts by bucket."""

    def __init__(self, words: DataFrame, pairs: DataFrame, buckets: int, total: int, types: int, pair_discounts: np.ndarray, unknown: float, threshold: int):
        self.words, self.pairs, self.buckets, self.total, self.types = words, pairs, buckets, total, types
        self.triples: DataFrame | None = None
        self.hot: dict[str, np.ndarray] = {}
        self.pair_discounts, self.unknown, self.threshold = pair_discounts, unknown, threshold


def fit(train: DataFrame, order: int = ORDER) -> Model:
    """The model of the texts of train (column text), of order 2 or 3."""
    spark = train.sparkSession
    texts = train.select(F.col("text").cast("string").alias("text"))
    words = _io.stored(texts.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    # counts up to 1024 one by one, higher ones by powers of two: a table of bounded size
    step = F.when(F.col("c") <= 1024, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("c").cast("double")) + 1e-9)).cast("long"))
    table = {int(r[0]): (int(r[1]), int(r[2])) for r in words.groupBy(step.alias("step")).agg(F.count("*"), F.sum("c")).collect()}
    total, types = sum(v[1] for v in table.values()), sum(v[0] for v in table.values())
    threshold, have = max(table, default=0) + 1, 0
    for s in sorted(table, reverse=True):
        if have + table[s][0] > VOCABULARY:
            break
        threshold, have = s, have + table[s][0]
    d1 = discounts([table.get(r, (0, 0))[0] for r in range(1, CUT + 2)])
    lost = sum((1 - d1[r]) * r * table.get(r, (0, 0))[0] for r in range(1, CUT + 1))
    whole = total + (lost == 0)
    unknown = (lost or 1.0) / whole
    numbered = words.where(F.col("c") >= threshold).toArrow()  # VOCABULARY rows at most
    voc = Vocabulary(numbered.column("w").to_numpy().view(U64), numbered.column("c").to_numpy())
    p1 = d1[np.minimum(voc.counts, CUT + 1)] * voc.counts / whole
    sc = spark.sparkContext
    voc_b, p1_b = sc.broadcast(voc), sc.broadcast(p1)
    _io.release(spark)
    buckets = max(8, -(-_io.size_of(texts) // BUCKET_BYTES))
    blocks = texts.mapInArrow(partial(_count_blocks, vocabulary=voc_b, buckets=buckets, order=order), "bucket long, kind string, block binary")
    counted = _io.stored(blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(partial(_count, vocabulary=voc_b, p1=p1_b), COUNTED_DDL), "counts")
    _io.release(spark)
    low = counted.where("kind = 'pairs'").agg(*(F.coalesce(F.sum(m), F.lit(0)) for m in LOW)).first()
    d2 = discounts(list(low))
    p_w = (discount_column(F.col("c"), d1) * F.col("c") / whole)
    rare = counted.where("kind = 'rare'").select("h", "w").join(words.select("w", p_w.alias("p")), "w").groupBy("h").agg(F.sum("p").alias("p"), F.lit(0.0).alias("lost"))
    gone = sum(((F.col(LOW[r - 1]) * (r * float(1 - d2[r]))) for r in range(1, CUT + 1)), F.lit(0.0))
    sums = counted.where("kind = 'history'").select("h", "p", gone.alias("lost")).unionByName(rare).groupBy("h").agg(F.sum("p").alias("seen"), F.sum("lost").alias("lost"))
    big = F.col("c") + F.when(F.coalesce("lost", F.lit(0.0)) > 0, 0).otherwise(1)
    left = F.when(F.coalesce("lost", F.lit(0.0)) > 0, F.col("lost")).otherwise(1.0) / big
    stats = words.join(sums, words.w == sums.h, "left").select("w", "c", F.log10(big).alias("d_log"), F.when(F.col("seen").isNull(), 0.0).otherwise(F.log10(left / F.greatest(1 - F.col("seen"), F.lit(1e-300)))).alias("a_log"), F.log10(p_w).alias("p_log"))
    stats = _io.stored(stats, "word-stats")
    pairs = _io.stored(counted.where("kind = 'pairs'").select("bucket", "block"), "pair-counts")
    model = Model(stats, pairs, buckets, total, types, d2, unknown, threshold)
    if order > 2:
        _third_order(model, counted)
    _io.drop_stored(counted)
    _io.drop_stored(words)
    _io.release(spark)
    return model


ASKED = "bucket long, kind string, origin long, block binary"


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The pairs at the ends of a bucket's kept triples, by the bucket that counts them."""
    for batch in batches:
        for origin, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
            _, v, w, *_ = unpack(block)
            at, order = _by_pair_bucket(v, w, buckets)
            cuts = [*_firsts(at).tolist(), len(at)]
            rows = [(int(at[a]), "pairs", origin, pack(v[order[a:b]], w[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "origin", "block"])


def _by_pair_bucket(v: np.ndarray, w: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in order, order) of pairs."""
    at = bucket_of(v, w, buckets)
    order = np.argsort(at, kind="stable")
    return at[order], order


@_text.trimmed
def _answer(batches: Iterator[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    """P(w | v) of pairs that were asked for; a bucket's counts come first among its rows."""
    s, counts = scorer.value, None
    for batch in batches:
        for bucket, kind, origin, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "origin", "block")), strict=True):
            if kind == "counts":
                h, w, c = unpack(block)
                counts = Counts(undelta(h), w, c)
                counts.weigh(s.discounts)
                continue
            v, w = unpack(block)
            c = counts.of(v, w)
            whole, inner = np.empty(len(v)), v < TOP
            whole[inner] = 10 ** s.d_log[v[inner].astype(np.int64)]
            whole[~inner] = counts.size(v[~inner])
            p = s.discounts[np.minimum(c, CUT + 1)] * c / whole
            yield pa.RecordBatch.from_arrays([pa.array([origin], pa.int64()), pa.array([bucket], pa.int64()), pa.array([pack(p.view(U64))], pa.binary())], names=["bucket", "pair_bucket", "block"])


WEIGHED = "kind string, bucket long, block binary, h long, p double"


@_text.trimmed
def _weigh(batches: Iterator[pa.RecordBatch], buckets: int, d3: np.ndarray, hot: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What each kept triple adds to the logarithm of its pair's probability, and the weights of histories that back off ('triples'); and
    the sums of the pairs' probabilities for hot histories ('hot')."""
    table, answers = None, []

    def out(kind, bucket, block, h, p):
        n = len(kind)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(bucket, pa.int64()), pa.array(block, pa.binary()), pa.array(h, pa.int64()), pa.array(p, pa.float64())] if n else [], names=[x.split()[0] for x in WEIGHED.split(", ")])

    def done():
        bucket, block = table
        u, v, w, c, hs, whole, *low = unpack(block)
        hs, c = undelta(hs), c.astype(np.int64)
        _, order = _by_pair_bucket(v, w, buckets)
        p2 = np.empty(len(v))
        if len(v):
            p2[order] = np.concatenate([unpack(b)[0] for _, b in sorted(answers)]).view(np.float64)
        ids, is_hot = history_id(u, v), (u < HOT) & (v < HOT)
        lost = sum((low[r - 1].astype(np.int64) * (r * (1 - d3[r])) for r in range(1, CUT + 1)), np.zeros(len(hs)))
        size = whole.astype(np.int64) + (lost == 0)
        mine = np.searchsorted(hs, ids[~is_hot])
        seen = np.bincount(mine, weights=p2[~is_hot], minlength=len(hs))
        alpha = np.log10(np.where(lost == 0, 1.0, lost) / size / np.maximum(1 - seen, 1e-300)) if len(hs) else np.zeros(0)
        of = np.empty(len(ids))
        of[~is_hot] = size[mine]
        of[is_hot] = hot["size"][np.searchsorted(hot["h"], ids[is_hot])] if is_hot.any() else 0
        gain = np.log10(d3[np.minimum(c, CUT + 1)] * c / of) - np.log10(p2)
        if is_hot.any():
            h, which = np.unique(ids[is_hot], return_inverse=True)
            yield out(["hot"] * len(h), [None] * len(h), [None] * len(h), _text.to_i64(h), np.bincount(which, weights=p2[is_hot]))
        yield out(["triples"], [bucket], [pack(u, v, w, gain.view(U64), delta(hs), alpha.view(U64))], [None], [None])

    for batch in batches:
        for bucket, pair_bucket, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "pair_bucket", "block")), strict=True):
            if pair_bucket is None:  # a bucket's triples come first among its rows
                if table is not None:
                    yield from done()
                table, answers = (bucket, block), []
            else:
                answers.append((pair_bucket, block))
    if table is not None:
        yield from done()


def _third_order(model: Model, counted: DataFrame) -> None:
    """Adds the tables of triples to a model of pairs: the pairs' probabilities are fetched from their buckets, then each kept triple gets what
    it adds to log10 P(w | v), and each history of a kept triple its backoff weight."""
    spark = counted.sparkSession
    kept = _io.stored(counted.where("kind = 'triples'").select("bucket", "block"), "triples")
    d3 = discounts(list(counted.where("kind = 'triples'").agg(*(F.coalesce(F.sum(m), F.lit(0)) for m in LOW)).first()))
    d3[1:KEPT] = 0.0
    gone = sum(((F.col(LOW[r - 1]) * (r * float(1 - d3[r]))) for r in range(1, CUT + 1)), F.lit(0.0))
    hot = counted.where("kind = 'hot'").groupBy("h").agg(F.sum("c").alias("c"), F.sum(gone).alias("lost")).orderBy("h").toArrow()  # HOT ** 2 rows at most
    c, lost = hot.column("c").to_numpy(), hot.column("lost").to_numpy()
    sizes = {"h": hot.column("h").to_numpy().view(U64), "size": c + (lost == 0)}
    scorer = _scorer(spark, model)
    asked = kept.mapInArrow(partial(_ask, buckets=model.buckets), ASKED)
    both = model.pairs.select("bucket", F.lit("counts").alias("kind"), F.lit(None).cast("long").alias("origin"), "block").unionByName(asked)
    answers = both.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", F.col("kind") != "counts").mapInArrow(partial(_answer, scorer=scorer), "bucket long, pair_bucket long, block binary")
    rows = kept.select("bucket", F.lit(None).cast("long").alias("pair_bucket"), "block").unionByName(answers)
    ready = rows.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", F.col("pair_bucket").asc_nulls_first())
    weighed = _io.stored(ready.mapInArrow(partial(_weigh, buckets=model.buckets, d3=d3, hot=sizes), WEIGHED), "triple-weights")
    seen = weighed.where("kind = 'hot'").groupBy("h").agg(F.sum("p").alias("p")).toArrow()  # HOT ** 2 rows at most
    total = np.zeros(len(c))
    total[np.searchsorted(sizes["h"], seen.column("h").to_numpy().view(U64))] = seen.column("p").to_numpy()
    alpha = np.log10(np.where(lost == 0, 1.0, lost) / sizes["size"] / np.maximum(1 - total, 1e-300)) if len(c) else np.zeros(0)
    model.triples, model.hot = weighed.where("kind = 'triples'").select("bucket", "block"), {"h": sizes["h"], "alpha": alpha}
    _io.drop_stored(kept)
    _io.release(spark)


class Scorer:
    """What every task needs of the numbered words."""

    def __init__(self, voc: Vocabulary, stats: dict[str, np.ndarray], model: Model):
        self.voc, self.buckets = voc, model.buckets
        self.d_log, self.a_log, self.p_log = stats["d_log"], stats["a_log"], stats["p_log"]
        self.base = np.log10((voc.counts + 1.0) / (model.total + model.types + 1))
        self.gain, self.discounts = np.log10(model.pair_discounts), model.pair_discounts


TO_SCORE = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("slice", pa.int64()), ("docs", pa.int64()), ("block", pa.binary()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
TO_SCORE_DDL = "bucket long, kind string, slice long, docs long, block binary, ids array<long>, ths array<long>, n array<long>, known array<long>, base array<double>"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _score_blocks(batches: Iterator[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    """A slice's documents ('docs'), its rare tokens ('rare'), and its pairs by bucket ('pairs')."""
    from pyspark import TaskContext

    s, at = scorer.value, TaskContext.get().partitionId() << 32
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        part = Slice(data, offs, s.voc)
        (bucket, h, w, doc), code, owner = part.pairs(s.buckets), part.code, part.doc
        docs = rows.num_rows
        numbered = code < TOP
        n = np.bincount(owner, minlength=docs)
        known = np.bincount(owner[numbered], minlength=docs)
        base = np.bincount(owner[numbered], weights=s.base[code[numbered].astype(np.int64)], minlength=docs)
        out = [(at % s.buckets, "docs", at, docs, None, rows.column("doc_id").to_pylist(), rows.column("th").to_pylist(), n, known, base)]
        if not numbered.all():
            out.append((at % s.buckets, "rare", at, docs, pack(owner[~numbered], code[~numbered]), None, None, None, None, None))
        first = _firsts(bucket, h, w)
        many = np.diff(np.append(first, len(h)))
        ends = np.append(first, len(h))
        cuts = [*_firsts(bucket[first]).tolist(), len(first)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out.append((int(bucket[first[a]]), "pairs", at, docs, pack(delta(h[first[a:b]]), w[first[a:b]], many[a:b], doc[ends[a] : ends[b]]), None, None, None, None, None))
        yield _rows(TO_SCORE, out)
        at += 1


SCORED = pa.schema([("kind", pa.string()), ("slice", pa.int64()), ("at", pa.int64()), ("w", pa.int64()), ("n_b", pa.int64()), ("n_a", pa.int64()), ("n_p", pa.int64()), *((f.name, f.type) for f in TO_SCORE if f.name in ("ids", "ths", "n", "known", "base")), ("sums", pa.list_(pa.float64()))])
SCORED_DDL = "kind string, slice long, at long, w long, n_b long, n_a long, n_p long, ids array<long>, ths array<long>, n array<long>, known array<long>, base array<double>, sums array<double>"


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _text.mix64(_text.mix64(h) * U64(_text.BASE) + w)


def _left_over(at: int, cols: list[tuple[np.ndarray, np.ndarray, str]]) -> pa.RecordBatch | None:
    """Rows of what words without a number still owe: documents, words and how often each term counts."""
    doc = np.concatenate([c[0] for c in cols])
    if not len(doc):
        return None
    word = np.concatenate([c[1] for c in cols])
    which = np.concatenate([np.full(len(c[0]), "bap".index(c[2])) for c in cols])
    order = np.lexsort((word, doc))
    doc, word, which = doc[order], word[order], which[order]
    first = _firsts(doc, word)
    n = [np.add.reduceat((which == k).astype(np.int64), first) for k in range(3)]
    k = len(first)
    return pa.RecordBatch.from_arrays([pa.array(["rare"] * k), pa.array(np.full(k, at)), pa.array(doc[first].astype(np.int64)), pa.array(_text.to_i64(word[first])), *(pa.array(x) for x in n), *(pa.nulls(k, SCORED.field(i).type) for i in range(7, 13))], schema=SCORED)


@_text.trimmed
def _score_pairs(batches: Iterator[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    """Scores pairs against their bucket's counts, which come first among its rows."""
    s, now, counts, none = scorer.value, None, None, (None,) * 3
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, counts = row["bucket"], Counts(NO_COUNTS, NO_COUNTS, NO_COUNTS)
            at = row["slice"]
            if row["kind"] == "counts":
                h, w, c = unpack(row["block"])
                counts = Counts(undelta(h), w, c)
                counts.weigh(s.discounts)
            elif row["kind"] == "docs":
                yield _rows(SCORED, [("docs", at, None, None, *none, row["ids"], row["ths"], row["n"], row["known"], row["base"], None)])
            elif row["kind"] == "rare":
                doc, word = unpack(row["block"])
                yield _left_over(at, [(doc, word, "b")])
            else:
                h, w, many, doc = unpack(row["block"])
                h = undelta(h)
                many, doc = many.astype(np.int64), doc.astype(np.int64)
                c = counts.of(h, w)
                seen, h_in, w_in = c > 0, h < TOP, w < TOP
                value = np.zeros(len(h))
                value[seen] = s.gain[np.minimum(c[seen], CUT + 1)] + np.log10(c[seen])
                x = seen & h_in
                value[x] -= s.d_log[h[x].astype(np.int64)]
                x = seen & ~h_in
                value[x] -= np.log10(counts.size(h[x]))
                x = ~seen & h_in
                value[x] += s.a_log[h[x].astype(np.int64)]
                x = ~seen & w_in
                value[x] += s.p_log[w[x].astype(np.int64)]
                yield _rows(SCORED, [("sums", at, None, None, *none, None, None, None, None, None, np.bincount(doc, weights=np.repeat(value, many), minlength=row["docs"]))])
                each = [(np.repeat(mask, many), term, of) for mask, term, of in ((~seen & ~h_in, "a", h), (~seen & ~w_in, "p", w))]
                rest = _left_over(at, [(doc[m].astype(U64), np.repeat(of, many)[m], term) for m, term, of in each])
                if rest is not None:
                    yield rest


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of each slice (rows sorted by slice) and gives a row per document."""
    docs: dict | None = None
    total, now = None, None

    def done():
        k = len(docs["ids"])
        return pa.RecordBatch.from_arrays([pa.array([now] * k, pa.int64()), pa.array(range(k), pa.int64()), pa.array(docs["ids"], pa.int64()), pa.array(docs["ths"], pa.int64()), pa.array(docs["n"], pa.int64()), pa.array(docs["known"], pa.int64()), pa.array(docs["base"], pa.float64()), pa.array(total if total is not None else [0.0] * k, pa.float64())], names=["slice", "at", "doc_id", "th", "n_tokens", "known", "base", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != now:
                if docs:
                    yield done()
                docs, total, now = None, None, row["slice"]
            if row["kind"] == "docs":
                docs = row
            else:
                total = np.array(row["sums"]) if total is None else total + np.array(row["sums"])
    if docs:
        yield done()


def _triple_blocks(batches: Iterator[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    """A slice's documents ('docs'), and its triples by bucket ('triples')."""
    from pyspark import TaskContext

    s, at = scorer.value, TaskContext.get().partitionId() << 32
    for rows, data, offs in _text.text_slices(batches, most=SLICE):
        bucket, u, v, w, doc = Slice(data, offs, s.voc).triples(s.buckets)
        docs = rows.num_rows
        out = [(at % s.buckets, "docs", at, docs, None, rows.column("doc_id").to_pylist(), rows.column("th").to_pylist())]
        first = _firsts(bucket, u, v, w)
        ends = np.append(first, len(bucket))
        many = np.diff(ends)
        cuts = [*_firsts(bucket[first]).tolist(), len(first)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            f = first[a:b]
            out.append((int(bucket[f[0]]), "triples", at, docs, pack(delta(u[f]), v[f], w[f], many[a:b], doc[ends[a] : ends[b]]), None, None))
        yield _rows(TRIPLES, out)
        at += 1


TRIPLES = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("slice", pa.int64()), ("docs", pa.int64()), ("block", pa.binary()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64()))])
TRIPLES_DDL = "bucket long, kind string, slice long, docs long, block binary, ids array<long>, ths array<long>"
ADDED = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64()))])
ADDED_DDL = "slice long, ids array<long>, ths array<long>, sums array<double>"


class Gains:
    """A bucket's kept triples and what they add, and the backoff weights of its histories; hot ones are common to all buckets."""

    def __init__(self, block: bytes | None, hot: dict[str, np.ndarray]):
        u, v, w, gain, hs, alpha = unpack(block) if block else [NO_COUNTS] * 6
        whole = (u < TOP) & (v < TOP) & (w < TOP)
        self.keys, self.gains = self._table(((u[whole] << WORD_BITS | v[whole]) << WORD_BITS) | w[whole], gain[whole])
        self.rare_keys, self.rare_gains = self._table(_pair_key(history_id(u[~whole], v[~whole]), w[~whole]), gain[~whole])
        self.hs, self.alpha, self.hot = undelta(hs), alpha.view(np.float64), hot

    @staticmethod
    def _table(keys: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], gain[order].view(np.float64)

    @staticmethod
    def _put(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, out: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Sets out, at the places `where`, to the values of keys that are there; returns whether they are."""
        if not len(keys):
            return np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        there = keys[at] == wanted
        out[where[there]] = values[at[there]]
        return there

    def of(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, found = np.zeros(len(u)), np.zeros(len(u), bool)
        whole = (u < TOP) & (v < TOP) & (w < TOP)
        first, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
        found[first] = self._put(self.keys, self.gains, ((u[first] << WORD_BITS | v[first]) << WORD_BITS) | w[first], out, first)
        found[rest] = self._put(self.rare_keys, self.rare_gains, _pair_key(history_id(u[rest], v[rest]), w[rest]), out, rest)
        left = np.flatnonzero(~found)
        hot = (u[left] < HOT) & (v[left] < HOT)
        for places, keys, alpha in ((left[hot], self.hot["h"], self.hot["alpha"]), (left[~hot], self.hs, self.alpha)):
            self._put(keys, alpha, history_id(u[places], v[places]), out, places)
        return out


@_text.trimmed
def _score_triples(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """What triples add to their documents' scores; a bucket's table comes first among its rows."""
    now, gains = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, gains = row["bucket"], Gains(row["block"] if row["kind"] == "counts" else None, hot.value)
            if row["kind"] == "docs":
                yield _rows(ADDED, [(row["slice"], row["ids"], row["ths"], None)])
            elif row["kind"] == "triples":
                u, v, w, many, doc = unpack(row["block"])
                value = gains.of(undelta(u), v, w)
                yield _rows(ADDED, [(row["slice"], None, None, np.bincount(doc.astype(np.int64), weights=np.repeat(value, many.astype(np.int64)), minlength=row["docs"]))])


def _add_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of each slice (rows sorted by slice, its documents first) and gives a row per document."""
    docs, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array(docs["ids"], pa.int64()), pa.array(docs["ths"], pa.int64()), pa.array(total)], names=["x_id", "x_th", "added"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                if docs is not None:
                    yield done()
                docs, total = row, np.zeros(len(row["ids"]))
            else:
                total += np.array(row["sums"])
    if docs is not None:
        yield done()


def _scorer(spark: SparkSession, model: Model):
    top = model.words.where(F.col("c") >= model.threshold).toArrow()  # VOCABULARY rows at most
    words, counts = top.column("w").to_numpy().view(U64), top.column("c").to_numpy()
    order = np.lexsort((words, -counts))
    stats = {n: top.column(n).to_numpy()[order] for n in ("d_log", "a_log", "p_log")}
    return spark.sparkContext.broadcast(Scorer(Vocabulary(words, counts), stats, model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs."""
    spark = docs.sparkSession
    scorer = _scorer(spark, model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    rows = texts.mapInArrow(partial(_score_blocks, scorer=scorer), TO_SCORE_DDL)
    counted = model.pairs.select("bucket", F.lit("counts").alias("kind"), "block")
    both = rows.unionByName(counted, allowMissingColumns=True)
    made = _io.stored(both.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", F.col("kind") != "counts").mapInArrow(partial(_score_pairs, scorer=scorer), SCORED_DDL), "scored")
    _io.release(spark)
    sums = made.where("kind <> 'rare'").select("slice", "kind", "ids", "ths", "n", "known", "base", "sums")
    per_doc = sums.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_add_up, "slice long, at long, doc_id long, th long, n_tokens long, known long, base double, score double")
    owed = made.where("kind = 'rare'").select("slice", "at", "w", "n_b", "n_a", "n_p").join(model.words, "w", "left")
    c = F.coalesce("c", F.lit(0))
    base = F.col("n_b") * F.log10((c + 1) / F.lit(float(model.total + model.types + 1)))
    more = F.col("n_a") * F.coalesce("a_log", F.lit(0.0)) + F.col("n_p") * F.coalesce("p_log", F.lit(float(np.log10(model.unknown))))
    owed = owed.groupBy("slice", "at").agg(F.sum(F.when(c > 0, F.col("n_b")).otherwise(0)).alias("known2"), F.sum(base).alias("base2"), F.sum(more).alias("score2"))
    out = per_doc.join(owed, ["slice", "at"], "left")
    zero = F.lit(0.0)
    out = out.select("doc_id", "th", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("score") + F.coalesce("score2", zero)).alias("score"))
    if model.triples is None:
        return out.drop("th")
    out = _io.stored(out, "pair-scores")
    _io.drop_stored(made)
    _io.release(spark)
    tables = model.triples.select("bucket", F.lit("counts").alias("kind"), "block")
    hot = spark.sparkContext.broadcast(model.hot)
    asked = texts.mapInArrow(partial(_triple_blocks, scorer=scorer), TRIPLES_DDL).unionByName(tables, allowMissingColumns=True)
    added = _io.stored(asked.repartition(model.buckets, "bucket").sortWithinPartitions("bucket", F.col("kind") != "counts").mapInArrow(partial(_score_triples, hot=hot), ADDED_DDL), "triple-scores")
    _io.release(spark)
    per_text = added.repartition("slice").sortWithinPartitions("slice", F.col("ids").isNull()).mapInArrow(_add_triples, "x_id long, x_th long, added double")
    # equal rows have equal sums, so a row's id and text find them
    per_text = per_text.groupBy("x_id", "x_th").agg(F.min("added").alias("added"))
    same = out.doc_id.eqNullSafe(per_text.x_id) & out.th.eqNullSafe(per_text.x_th)
    return out.join(per_text, same, "left").withColumn("score", F.col("score") + F.coalesce("added", zero)).drop("th", "x_id", "x_th", "added")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")

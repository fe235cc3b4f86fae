"""Every operator against a plain version of it on the smallest tables."""

import collections
import functools
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acctframe.llm import _bpe, _io, _text, audio, chosen_path, decontam, edit_counts, katz, packing, quality, queries, suffix_dedup, token_files, warc_audit

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id").itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def encoder():
    return _bpe.Encoder(_bpe.default_vocabulary())


def by_doc(df):
    return {r.doc_id: r for r in df.collect()}


def test_encoder_equals_library(docs, encoder):
    rng = random.Random(1)
    alphabet = "ab cD'\n\t 12é,!.\xa0  \n  s't  ñß日本\x1c\x85᠎​"
    texts = list(docs.values())[:60] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for _, data, offs in _text.text_slices(iter([pa.record_batch({"text": texts})]), most=5000):
        ids, at = encoder.batch(data, offs)
        for i in range(len(offs) - 1):
            assert ids[at[i] : at[i + 1]].tobytes() == encoder.whole(data[offs[i] : offs[i + 1]].tobytes().decode())


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("vocabulary", [1 << 19, 40])
def test_katz(spark, sf, docs, monkeypatch, vocabulary, order):
    monkeypatch.setattr(katz, "VOCABULARY", vocabulary)
    monkeypatch.setattr(katz, "SPREAD", 8)
    monkeypatch.setattr(katz, "HOT", 5)
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)), None] for k, t in docs.items()}
    train = {k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2}
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for k in train:
        h = None
        for w in words[k]:
            one[w] += 1
            two[h, w] += 1
            after[h].add(w)
            h = w
    total = sum(one.values())
    d1, d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2)]) for c in (one, two))
    disc = lambda d, c: d[min(c, katz.CUT + 1)] * c
    lost = sum(c - disc(d1, c) for c in one.values())
    unknown = (lost or 1) / (total + (lost == 0))
    p1 = lambda w: disc(d1, one[w]) / (total + (lost == 0)) if one[w] else unknown
    size, alpha = {}, {}
    for h, seen in after.items():
        gone = sum(two[h, w] - disc(d2, two[h, w]) for w in seen)
        size[h] = one[h] + (gone == 0)
        alpha[h] = (gone or 1) / size[h] / (1 - sum(map(p1, seen)))
    p = lambda h, w: disc(d2, two[h, w]) / size[h] if two[h, w] else alpha.get(h, 1.0) * p1(w)
    for h in list(after)[:4]:
        assert abs(sum(p(h, w) for w in one) + alpha[h] * unknown - 1) < 1e-9
    three, kept, size3, alpha3 = collections.Counter(), collections.defaultdict(dict), {}, {}
    if order > 2:
        for k in train:
            u, v = None, None
            for w in words[k]:
                three[u, v, w] += 1
                u, v = v, w
        d3 = katz.discounts([sum(n == r for n in three.values()) for r in range(1, katz.CUT + 2)])
        d3[1 : katz.KEPT] = 0
        mass, lost3 = collections.Counter(), collections.Counter()
        for (u, v, w), c in three.items():
            mass[u, v] += c
            lost3[u, v] += c - disc(d3, c)
            if c >= katz.KEPT:
                kept[u, v][w] = c
        for uv, seen in kept.items():
            gone = lost3[uv] if lost3[uv] > 1e-12 else 0
            size3[uv] = mass[uv] + (gone == 0)
            alpha3[uv] = (gone or 1) / size3[uv] / (1 - sum(p(uv[1], w) for w in seen))
        assert len(kept) > 100 and any(len(x) > 1 for x in kept.values())
    p2 = p
    p = lambda u, v, w: disc(d3, kept[u, v][w]) / size3[u, v] if w in kept.get((u, v), {}) else alpha3.get((u, v), 1.0) * p2(v, w)
    for u, v in list(kept)[:4]:
        assert abs(sum(p(u, v, w) for w in one) + alpha3[u, v] * alpha.get(v, 1.0) * unknown - 1) < 1e-9
    table = spark.read.parquet(f"{sf}/documents.parquet")
    if order == 2:
        model = katz.fit(table.where(~katz.held_out(table.doc_id)), 2)
        got = by_doc(katz.score(table, model).withColumn("held_out", katz.held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(model.total)))
    else:
        got = by_doc(katz.query(spark, sf))
    better = 0
    for k, ws in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k not in train, len(ws), sum(one[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(u, v, w)) for u, v, w in zip([None, None, *ws[:-2]][: len(ws)], [None, *ws[:-1]], ws, strict=True)), rel_tol=1e-7)
        better += r.score > r.base_score
    assert better > 0.9 * len(docs)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_chosen_path(spark, sf, docs, monkeypatch, bucket):
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    sets, where = {}, collections.defaultdict(list)
    for k, t in docs.items():
        w = t.translate(LOWER).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[k]:
            where[s].append(k)
    links, parent = collections.Counter(), {k: k for k in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        both = collections.Counter(o for x in s for o in where[x])
        for o, n in both.items():
            if o != k and n >= 0.8 * (len(s) + len(sets[o]) - n) - 1e-9:
                links[k] += 1
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    got = by_doc(chosen_path.query(spark, sf))
    assert sum(links.values()) > 0
    assert {k: got[k].n_links for k in docs} == {k: links[k] for k in docs}
    assert {k: got[k].class_id for k in docs} == {k: root(k) for k in docs}


@pytest.mark.parametrize("bucket", [20, 16, 12])
def test_near_alike_kinds_of_one_node(spark, monkeypatch, bucket):
    """Nodes of up to 30 kinds that no level splits, in 3, 4 and 5 blocks."""
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    words = [f"w{i}" for i in range(600)]
    texts = {k: words[: 20 * k] + [f"own{k}"] + words[20 * k + 1 :] for k in range(30)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    assert all(len(a & b) >= 0.9 * len(a | b) for a in sets.values() for b in sets.values())
    got = by_doc(chosen_path.classes(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")))
    assert {k: got[k].n_links for k in texts} == dict.fromkeys(texts, 29)
    assert {got[k].class_id for k in texts} == {0}


def test_similar_sets_of_unlucky_minhashes_are_close():
    """Of many pairs that share 8 of 10 values, also those whose minhashes agree least."""
    n, rng = 60_000, np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (n, 10), dtype=np.uint64)
    both = np.stack((base[:, :9], np.delete(base, 7, axis=1)), axis=1)
    sketch = chosen_path.minhashes(both.reshape(-1), np.arange(2 * n + 1) * 9).reshape(n, 2, -1)
    agree = np.count_nonzero(sketch[:, 0] == sketch[:, 1], axis=1)
    worst = np.argsort(agree)[:20]
    assert agree[worst[0]] < 85 and all(len(chosen_path.close_pairs(sketch[k])[0]) == 1 for k in worst)


def test_hilbert_curve_visits_neighbours():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, sf, docs, encoder):
    rows = packing.query(spark, sf).collect()
    ids = {k: np.append(np.frombuffer(encoder.whole(t), "<u4"), 1).astype("<u4") for k, t in docs.items()}
    seen = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        seen[r.doc_id].append(ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(seen[r.doc_id][-1].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert r.start == sum(map(len, seen[r.doc_id][:-1]))
    assert {k: sum(map(len, v)) for k, v in seen.items()} == {k: len(v) for k, v in ids.items()}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        short += at < 2048
        assert at <= 2048
    assert short <= 1


def test_token_files(spark, sf, docs, encoder, tmp_path):
    got, start = by_doc(token_files.query(spark, sf)), 0
    for k, t in docs.items():
        ids = np.append(np.frombuffer(encoder.whole(t), "<u4"), 0).astype("<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    out = f"{tmp_path}/tokens"
    token_files.write_token_files(_io.table(spark, sf, "documents"), out, _bpe.default_vocabulary(), shard_bytes=40_000)
    index = token_files.build_index(spark, out).cache()
    assert index.select("shard").distinct().count() > 1
    read = token_files.shuffled_read(spark, out, index, seed=7, n=20).collect()
    assert len({r.doc_id for r in read}) == 20
    for r in read:
        assert np.array(r.ids[:-1], "<u4").tobytes() == encoder.whole(docs[r.doc_id]) and r.ids[-1] == 0


def test_broken_frames_are_found():
    good = token_files.frame(token_files.pack(5, np.array([1, 70000], "<u4"))) + b"\n"
    assert [token_files.unpack(p)[1].tolist() for _, _, p in token_files.frames(good + good)] == [[1, 70000]] * 2
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.frames(bytes(bad)))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = by_doc(quality.query(spark, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in labels if k in got and got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert len(held) > 80 and sum(got[k].predicted == labels[k] for k in held) >= 0.97 * len(held)


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for t in range(60):
        x = np.array([rng.choice([0, 1, 2, 97] if t % 2 else [65, 66]) for _ in range(rng.randint(1, 300))], np.uint8)
        x = np.concatenate((x, x, x)) if t % 3 == 0 else x
        raw, order = x.tobytes(), suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for k, n in list(enumerate(suffix_dedup.common_prefixes(x, order).tolist()))[1:]:
            a, b = raw[order[k - 1] :], raw[order[k] :]
            m = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
            assert n == min(m, 400)


@pytest.mark.parametrize("kinds", [2048, 2])
def test_suffix_dedup(spark, sf, docs, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "SHARD_KINDS", kinds)
    raw = {k: t.encode() for k, t in docs.items()}
    count = collections.Counter(b[p : p + 400] for b in raw.values() for p in range(len(b) - 399))
    got = by_doc(suffix_dedup.query(spark, sf))
    for k, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p + 1 : p + 401] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())


def edited(b, s, e, new):
    """b with the bytes from s to e replaced, as edits are defined."""
    s = min(max(s, 0), len(b))
    e = min(max(e, s), len(b))
    while 0 < s < len(b) and b[s] & 0xC0 == 0x80:
        s -= 1
    while 0 < e < len(b) and b[e] & 0xC0 == 0x80:
        e += 1
    return b[:s] + new + b[max(s, e) :]


def test_edit_counts(encoder, docs):
    """Random edits of many trees at once, against whole texts encoded anew."""
    rng = random.Random(5)
    alphabet = "ab cD'\n\t 12é,!. \n  s't  ñß日本 \n"
    texts = [t.encode() for t in [*list(docs.values())[:40], "", "a", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(60))]]
    trees = [edit_counts.plant(encoder, b) for b in texts]
    for _ in range(8):
        edits = []
        for b in texts:
            s = rng.randint(0, len(b))
            edits.append([(s, min(len(b), s + rng.choice([0, 0, 1, 5, 600])), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 9, 900]))).encode()) for _ in range(rng.choice([0, 1, 2]))])
        edit_counts.edit_all(encoder, trees, edits)
        texts = [functools.reduce(lambda x, e: edited(x, *e), each, b) for b, each in zip(texts, edits, strict=True)]
        for tree, b in zip(trees, texts, strict=True):
            assert tree.text() == b and tree.total == len(encoder.whole(b.decode())) // 4 == tree.of_leaves(tree.tokens).sum()


def test_edit_counts_query(spark, sf, docs, encoder):
    got = by_doc(edit_counts.query(spark, sf))
    for k, t in docs.items():
        b, n = t.encode(), len(t.encode())
        for s, e, new in ((n // 4, n // 4, b" inserted, here"),):
            b = edited(b, s, e, new)
        b = edited(b, n // 2, n // 2 + 24, b"")
        b = edited(b, n - 8, n, b" end.")
        r = got[k]
        assert (r.n_tokens, r.n_edits, r.edited_bytes) == (len(encoder.whole(t)) // 4, 3, len(b))
        assert r.edited_tokens == len(encoder.whole(b.decode())) // 4
        assert len(t) < 20_000 or r.encoded_bytes < len(b) / 4


def test_trees_are_kept_and_edited_again(spark, sf, docs, encoder):
    """Edits of two tables one after the other; documents without edits are not tokenised."""
    trees = _io.stored(edit_counts.build(_io.table(spark, sf, "documents"), _bpe.default_vocabulary()), "trees")
    b = docs[0].encode()
    at = b.index(b" ")
    kind = "doc_id long, seq long, start long, end long, new string"
    first = spark.createDataFrame([(0, 1, 0, 0, "X "), (0, 0, at, at + 1, None)], kind)
    once = _io.stored(edit_counts.apply_edits(edit_counts.with_edits(trees, first), _bpe.default_vocabulary()), "trees")
    rows, b = by_doc(once), b"X " + b[:at] + b[at + 1 :]
    assert rows[0].n_edits == 2 and rows[0].edited_tokens == len(encoder.whole(b.decode())) // 4 and rows[0].text.encode() == b
    assert all(r.encoded_bytes == 0 and r.n_tokens == r.edited_tokens and r.text == docs[k] for k, r in rows.items() if k)
    again = spark.createDataFrame([(0, 0, len(b), len(b) + 5, " last words")], kind)
    r = by_doc(edit_counts.apply_edits(edit_counts.with_edits(once, again), _bpe.default_vocabulary()))[0]
    assert r.n_tokens == rows[0].edited_tokens and r.edited_tokens == len(encoder.whole(b.decode() + " last words")) // 4 and sum(r.leaf_bytes) == len(b) + 11


def test_decontamination(spark, sf, docs):
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(LOWER))
    windows = collections.defaultdict(set)
    for k, t in bench:
        w = find(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(k))
    sizes, got = {len(w) for w in windows}, by_doc(decontam.query(spark, sf))
    for k, t in docs.items():
        w, hit, ids = find(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    whole = decontam.query(spark, sf).collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 4000)
    assert sorted(decontam.query(spark, sf).collect()) == sorted(whole)


def test_spans_point_to_the_original():
    text = "Intro, über  ALLES — " + ", ".join(f"Wörd{i}" for i in range(15)) + " end."
    m = decontam.Matcher([(1, " ".join(f"wörd{i}" for i in range(15)))])
    raw = text.encode()
    runs, ids = m.runs(decontam.normal_words(raw))
    span = decontam.original_spans(np.frombuffer(raw, np.uint8), decontam.merged(runs))[0]
    assert ids == {"1"} and raw[span["start"] : span["end"]].decode() == ", ".join(f"Wörd{i}" for i in range(15))


@pytest.fixture(scope="module")
def replicas(spark, sf, tmp_path_factory):
    """Records of the pages in several files, and a function that reads a replica in which some are changed."""
    d = str(tmp_path_factory.mktemp("warc"))
    pages = _io.table(spark, sf, "pages").unionByName(_io.table(spark, sf, "pages").where("page_id < 2"))
    path = warc_audit.write_replicas(warc_audit.records(pages), f"{d}/written", {"first": None})["first"]
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))

    def changed(name, change):
        os.makedirs(f"{d}/{name}", exist_ok=True)
        for k, n in enumerate(names):
            with open(f"{path}/{n}", "rb") as f:
                raw = f.read()
            raw = change(k, raw)
            if raw is not None:
                with open(f"{d}/{name}/{n}", "wb") as f:
                    f.write(raw)
        return warc_audit.read_replica(spark, f"{d}/{name}")

    return warc_audit.read_replica(spark, path), changed, names


@pytest.fixture(scope="module", autouse=True)
def small_files():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc_audit, "FILE_BYTES", 20_000)
        yield


def warc_states(first, second):
    return sorted((r.file_id, r.idx, r.state) for r in warc_audit.audit(first, second).collect())


def test_warc_records_come_back(spark, sf, replicas):
    first, _, names = replicas
    rows, pages = first.collect(), _io.table(spark, sf, "pages").collect()
    assert len(names) > 3 and len(rows) == len(pages) + 2 and None not in {r.record_id for r in rows}
    for p in pages:
        html = (p.html or "").encode()
        rec = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{p.page_id}>\r\nWARC-Target-URI: {p.url}\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html + b"\r\n\r\n"
        mine = [r for r in rows if r.record_id == str(p.page_id)]
        assert len(mine) == 1 + (p.page_id < 2) and all((r.size, r.record_sha256, r.content) == (len(rec), hashlib.sha256(rec).hexdigest(), hashlib.sha256(warc_audit.member(rec)).hexdigest()) for r in mine)


def test_warc_audit_finds_a_record_missing_in_the_middle(replicas):
    first, changed, _ = replicas
    spot = {}

    def cut(k, raw):
        if k != 1:
            return raw
        spots = list(warc_audit.walk(raw))
        spot["n"], (at, n, *_) = len(spots), spots[1]
        return raw[:at] + raw[at + n :]

    assert warc_states(first, changed("cut", cut)) == [(1, 1, "missing")] and spot["n"] > 2
    back = changed("same", lambda k, raw: raw)
    assert warc_states(first, back) == []


def test_warc_audit_finds_added_and_lost_files(replicas):
    first, changed, names = replicas
    second = changed("lost", lambda k, raw: None if k == 2 else raw)
    gone = sorted((r.file_id, r.idx) for r in first.where("file_id = 2").collect())
    assert warc_states(first, second) == [(*g, "missing") for g in gone] and warc_states(second, first) == [(*g, "added") for g in gone]


@pytest.mark.parametrize("base", [0, 4, 8])
def test_warc_audit_finds_any_damaged_byte(replicas, base):
    """Bytes of a stored record's head, body and end, another one in each file; records around it stay."""
    first, changed, names = replicas
    want = []

    def harm(k, raw):
        spots = list(warc_audit.walk(raw))
        if len(spots) < 3:
            return raw
        at, n, *_ = spots[1]
        raw, spot = bytearray(raw), at + [0, 1, 2, 3, 4, 9, 10, n // 3, n // 2, n - 9, n - 5, n - 1][(base + k) % 12]
        raw[spot] ^= 0x21
        want.append((k, 1, "corrupt"))
        return bytes(raw)

    assert warc_states(first, changed(f"harm{base}", harm)) == want and len(want) > 3


def test_audio(spark, sf, docs):
    for k, r in by_doc(audio.query(spark, sf)).items():
        b = docs[k].encode()
        payload = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(audio.to_wav(payload)).hexdigest()
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    out = audio.resample(tone)
    assert len(out) == len(tone) * 2 // 3
    spectrum = np.abs(np.fft.rfft(out))
    assert abs(np.argmax(spectrum) * audio.OUT_RATE / len(out) - 1000) < 2
    x = np.concatenate((np.zeros(50), np.ones(10), np.full(10, 0.5), np.zeros(30)))
    assert audio.segments(x).tolist() == [[50, 70]]
    rows = audio.tensors(audio.to_media(_io.table(spark, sf, "documents").limit(3))).toArrow()
    assert audio.tensor_array(rows.column("tensor").combine_chunks()).type.shape == [64, 24]


def test_audio_query_stores_tensors(spark, sf, docs, monkeypatch):
    kept, stored = {}, _io.stored
    monkeypatch.setattr(_io, "stored", lambda df, kind: kept.setdefault(kind, stored(df, kind)))
    monkeypatch.setattr(audio, "GATHERED", 5000)
    got, found = by_doc(audio.query(spark, sf)), by_doc(kept["tensors"])
    assert set(found) == set(docs) and max(len(r.blocks) for r in found.values()) > 1
    for k, t in docs.items():
        b = t.encode()
        mel, sound = audio.features(np.frombuffer(b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b)), np.uint8))
        flat = np.array([x.tensor for x in found[k].blocks], np.float32).reshape(-1, audio.MELS)
        assert len(flat) % audio.FRAMES == 0 and (flat[: len(mel)] == mel).all() and not flat[len(mel) :].any()
        mean = ",".join(f"{v:.2f}" for v in mel.mean(axis=0, dtype=np.float64))
        assert got[k].feature == f"frames={len(mel)};sound={len(sound)};sound_frames={(sound[:, 1] - sound[:, 0]).sum()};mel={mean}"


def test_pipeline(spark, sf):
    docs = _io.table(spark, sf, "documents")
    want = collections.Counter()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _io.stored(stage(spark, docs, sf), name)
        want[name] = docs.count()
    assert want["quality_classifier"] >= want["ngram_jaccard_join"] == want["suffix_array_dedup"] >= want["benchmark_decontamination"] > 100
    tokens = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(tokens) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_blocks_do_not_change_results(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 110, 60_000).astype(np.uint8)
    text[rng.integers(0, len(text), 9000)] = 32
    starts, ends, _ = _text.words(text, np.array([0, len(text)]))
    whole = _text.word_hashes(text, starts, ends)
    names = suffix_dedup.window_names(text)
    monkeypatch.setattr(_text, "HASH_BLOCK", 5000)
    monkeypatch.setattr(suffix_dedup, "NAME_BLOCK", 7000)
    assert (_text.word_hashes(text, starts, ends) == whole).all()
    first, count, name = suffix_dedup.window_names(text)
    spread = lambda f, n, v: np.repeat(v, n)
    assert (spread(first, count, name) == spread(*names)).all() and len(first) > len(names[0])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())

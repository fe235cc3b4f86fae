"""Plain versions of what the brute-force tests take from the operators, the pipeline stage by stage, names that clash, long texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from acctframe.llm import _bpe, _io, _text, audio, chosen_path, decontam, quality, queries, suffix_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def parts(texts):
    """(weight by hash place) of each text, from the n-gram streams."""
    for _, data, offs in _text.text_slices(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        n, streams = quality.streams(data, offs)
        out = [collections.Counter() for _ in texts]
        for scale, (owner, where) in zip(quality.SCALE, streams, strict=True):
            for o, w in zip(owner.tolist(), where.tolist(), strict=True):
                out[o][w] += scale / max(1, int(n[o]))
        return out


def test_streams_hold_the_ngrams():
    text = "The cat, the CAT sat."
    n, streams = quality.streams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert n.tolist() == [5] and [len(s[1]) for s in streams] == [5, 4, 5, 4, 3]
    spelt = streams[0][1].tolist()
    assert spelt[0] == spelt[2] and spelt[1] != spelt[3] and len(set(streams[1][1].tolist())) == 4


def test_ftrl_equals_a_plain_version(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs][:40]
    texts, ys = [docs[k] for k, _ in labels], [q for _, q in labels]
    bias, z, n = 1 << quality.BITS, collections.Counter(), collections.Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    rows = [{**p, bias: 1.0} for p in parts(texts)]
    for _ in range(quality.EPOCHS):
        for x, y in zip(rows, ys, strict=True):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = quality.train(texts, ys)
    for i in z:
        assert math.isclose(got[i], weight(i), rel_tol=1e-6, abs_tol=1e-9)
    assert np.count_nonzero(got) <= len(z)
    for _, data, offs in _text.text_slices(iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        scores = quality.scores(data, offs, got)
    for x, s in zip(rows, scores, strict=True):
        assert math.isclose(s, 1 / (1 + math.exp(-sum(got[i] * v for i, v in x.items()))), rel_tol=1e-9)


def test_resampling_equals_filtering_of_the_stretched_signal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400).astype(np.float32)
    n = np.arange(audio.UP * audio.TAPS) - (audio.UP * audio.TAPS - 1) / 2
    h = np.sinc(n / 3) / 3 * np.hamming(audio.UP * audio.TAPS)
    gain = [h[p :: audio.UP].sum() for p in range(audio.UP)]
    stretched = np.zeros(len(x) * audio.UP)
    stretched[:: audio.UP] = x
    full = np.convolve(stretched, h)
    out = audio.resample(x)
    for m in range(30, len(out) - 30):
        at = m * audio.DOWN
        # the filter's middle, as far as it can, lies over the sample
        near = [full[at + s] / gain[(at + s) % audio.UP] for s in range(audio.UP * audio.TAPS // 2 - 4, audio.UP * audio.TAPS // 2 + 5)]
        assert min(abs(out[m] - v) for v in near) < 1e-4


def test_log_mel_equals_the_definition():
    rng = np.random.default_rng(2)
    x = rng.normal(size=1000).astype(np.float32)
    got = audio.log_mel(x)
    assert got.shape == ((1000 - audio.WIN) // audio.HOP + 1, audio.MELS)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (audio.WIN - 1)) for k in range(audio.WIN)]
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(audio.OUT_RATE / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    for f in (0, 3):
        frame = [float(v) * w for v, w in zip(x[f * audio.HOP : f * audio.HOP + audio.WIN], window, strict=True)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * k * t / audio.WIN), -math.sin(2 * math.pi * k * t / audio.WIN)) for t, v in enumerate(frame))) ** 2 for k in range(audio.WIN // 2 + 1)]
        for b in range(audio.MELS):
            lo, mid, hi = edges[b : b + 3]
            energy = sum(p * max(0.0, min((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) for p, hz in zip(power, np.linspace(0, audio.OUT_RATE / 2, len(power)).tolist(), strict=True))
            assert math.isclose(got[f, b], math.log10(energy + 1e-6), abs_tol=2e-3)


def components(docs):
    """Least doc_id of each document's class, by comparing all sets that share a shingle."""
    sets, where, parent = {}, collections.defaultdict(list), {k: k for k in docs}
    for k, t in docs.items():
        w = (t or "").translate(LOWER).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for s in sets[k]:
            where[s].append(k)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for o, n in collections.Counter(o for x in s for o in where[x]).items():
            if n >= 0.8 * (len(s) + len(sets[o]) - n) - 1e-9:
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in docs}


def without_repeats(docs, n):
    raw = {k: t.encode() for k, t in docs.items()}
    count = collections.Counter(b[p : p + n] for b in raw.values() for p in range(len(b) - n + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = True
        out[k] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def contaminated(text, windows):
    w, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_every_stage_of_the_pipeline(spark, sf):
    """Each stage's rows, from what the stage before it kept."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    whole, now = {r.doc_id: r for r in rows.collect()}, rows
    text = {k: r.text for k, r in whole.items()}
    weights = quality.fit(rows, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {}
    for k, p in zip(text, parts(list(text.values())), strict=True):
        score[k] = sum(float(weights[i]) * v for i, v in p.items()) + float(weights[-1])
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOWER)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12) if w else 0)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = _io.stored(stage(spark, now, sf), name)
        if name == "quality_classifier":
            text = {k: t for k, t in text.items() if score[k] >= 0}
        elif name == "ngram_jaccard_join":
            text = {k: text[k] for k, c in components(text).items() if c == k}
        elif name == "suffix_array_dedup":
            text = without_repeats(text, suffix_dedup.STAGE_LENGTH)
        else:
            text = {k: t for k, t in text.items() if not contaminated(t, windows)}
        got = {r.doc_id: r for r in now.collect()}
        assert now.columns == rows.columns and {k: r.text for k, r in got.items()} == text and len(text) > 50
        assert all((r.lang, r.source) == (whole[k].lang, whole[k].source) for k, r in got.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    enc = _bpe.Encoder(_bpe.default_vocabulary())
    seen = collections.defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        seen[r.doc_id].append(r)
    for k, t in text.items():
        ids = np.append(np.frombuffer(enc.whole(t), "<u4"), 1).astype("<u4")
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in seen[k]] == [r.ids_crc32 for r in seen[k]] and sum(r.length for r in seen[k]) == len(ids)
    assert set(seen) == set(text)


CLASHING = ["__decontamination", "__repeated_ranges", "__quality_score", "__r_id", "__R_TH", "__x_id", "__x_th", "__many", "th", "kind", "class_id", "curve", "tie", "part", "row", "ranges", "score", "words", "count"]


def test_stages_with_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for n, name in enumerate(CLASHING):
        docs = docs.withColumn(name, docs.doc_id * 100 + n)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, docs, sf), stage(spark, plain, sf)
        if name == "hilbert_packing":
            assert sorted(got.select("doc_id", "start", "length", "ids_crc32").collect())[0] and got.columns == want.columns
            continue
        assert got.columns == docs.columns
        assert sorted(got.select("doc_id", "text").collect()) == sorted(want.select("doc_id", "text").collect())
        assert all(r[c] == r.doc_id * 100 + n for r in got.collect() for n, c in enumerate(CLASHING))


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """One text of 24 MB that holds a passage twice, and a short one."""
    d = str(tmp_path_factory.mktemp("long"))
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 10, 3000)]
    body = " ".join(words[i] for i in rng.integers(0, len(words), 3_600_000))
    passage = " ".join(words[i] for i in rng.integers(0, len(words), 120))
    text = f"{passage} {body} {passage}"
    assert len(text) > 20 << 20
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, text, passage


def test_operators_on_a_very_long_text(spark, long_texts):
    d, text, passage = long_texts
    by = lambda n: {r.doc_id: r for r in queries.queries()[n](spark, d).collect()}
    r = by("op8_aho_decontamination")[1]
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(text.split()), 2 * len(passage.split()), 1, False)
    r = by("op10_audio_features")[1]
    payload = text.encode() + b" " * (-len(text) % 192)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
    r = by("op4_token_files")[1]
    head = np.frombuffer(_bpe.Encoder(_bpe.default_vocabulary()).whole(text), "<u4")
    assert r.n_tokens == len(head) + 1 and r.ids_crc32 == zlib.crc32(np.append(head, 0).astype("<u4").tobytes())
    r = by("op6_suffix_dedup")[1]
    assert r.n_removed >= 2 * len(passage) and r.n_spans == 2
    r = by("op2_chosen_path_join")[1]
    assert (r.class_id, r.n_links) == (1, 0)


def test_items_are_cut_in_parts(spark, sf, monkeypatch):
    whole = sorted(decontam.query(spark, sf).collect())
    monkeypatch.setattr(decontam, "PART", 3)
    assert sorted(decontam.query(spark, sf).collect()) == whole


def test_labels_are_bounded_and_valid(spark, monkeypatch):
    """Repeated ids count once, labels other than 0 and 1 not at all, and training stops at its bounds."""
    docs = spark.createDataFrame([(k, f"word{k} more words", "x") for k in (0, 0, 1, 7, 9)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (7, 7), (9, None)], "doc_id long, quality int")
    both = quality.fit(docs, labels)
    assert (both == quality.train(["word0 more words", "word1 more words"], [1, 0]).astype("<f4")).all() or (both == quality.train(["word1 more words", "word0 more words"], [0, 1]).astype("<f4")).all()
    monkeypatch.setattr(quality, "TRAIN_ROWS", 1)
    one = quality.fit(docs, labels)
    assert any((one == quality.train([t], [y]).astype("<f4")).all() for t, y in (("word0 more words", 1), ("word1 more words", 0)))


def test_packing_shares_bytes_over_tasks(spark, monkeypatch):
    """Ranges of about equal bytes, though a third of the rows are one text and some texts are long."""
    from acctframe.llm import packing

    monkeypatch.setattr(packing, "TASK_BYTES", 40_000)
    rows = [(k, "same text of a large group of copies " * 10) for k in range(300)] + [(None, "no id")] * 300 + [(1000 + k, " ".join(f"w{k * j % 97}" for j in range(1 + 40 * (k % 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(docs, _bpe.default_vocabulary()).collect()
    size = collections.Counter()
    for r in pieces:
        size[r.sequence_id >> 32] += r.length
    tasks = [n for p, n in size.items() if p < 1 << 30]
    assert len(tasks) > 8 and max(tasks) < 2.5 * sum(tasks) / len(tasks)
    ends = [r for r in pieces if r.start + r.length == r.doc_tokens]
    assert len(ends) == len(rows) and sum(size.values()) == sum(r.doc_tokens for r in ends)


def test_chosen_path_at_many_blocks(spark, monkeypatch):
    """120 near-alike documents with buckets of 40 and of 16: every link is found."""
    words = [f"w{i}" for i in range(900)]
    texts = {k: words[: 7 * k] + [f"own{k}"] + words[7 * k + 1 :] for k in range(120)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    want = {k: sum(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in sets.values()) - 1 for k, s in sets.items()}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    for bucket in (40, 16):
        monkeypatch.setattr(chosen_path, "BUCKET", bucket)
        assert {r.doc_id: r.n_links for r in chosen_path.classes(docs).collect()} == want


def test_runs_reach_the_target_recall(monkeypatch):
    """The expected recall against simulated pairs that go down the tree, and the runs that targets need."""
    assert chosen_path.RUNS == 4 and chosen_path.runs_for(0.9) == 1 and 0.9999 < chosen_path.expected_recall(4) < 0.99997
    rng, n, found = np.random.default_rng(6), 4000, 0
    same = rng.random((n, chosen_path.PLACES)) < 0.8
    left = np.where(same, 1, 2).astype(np.uint32)
    right = np.ones_like(left)
    for k in range(n):
        alive = np.array([1], np.uint64)
        for _ in range(12):
            sides = [np.concatenate(chosen_path.children(alive, np.repeat(x[k : k + 1], len(alive), 0))) for x in (left, right)]
            alive = np.unique(sides[0][sides[0] == sides[1]])[:64]
            if not len(alive):
                break
        found += len(alive) > 0
    assert abs(found / n - chosen_path.expected_recall(1)) < 0.02


def test_spans_of_equal_rows_are_removed(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(1200))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[100:700]), (2, "x")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in suffix_dedup.strip_repeats(spark, docs, "").collect()}
    assert (1, "") in got and (None, "") in got and (2, "x") in got

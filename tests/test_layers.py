"""Reads through a delta, segment streams, stores and caches: plans and edge cases."""

import os
import re
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from acctframe import api, cache, shared, views
from acctframe.functions import columns as C
from acctframe.operators import predicates as P
from acctframe.operators import sets, stats, versions
from acctframe.plans import planner
from acctframe.sources import records, segments
from acctframe.streaming import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def layers(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("layers"))
    views.base_cust(spark, sf).write.parquet(f"{d}/base")
    ingest.append_updates(views.upd_orders(spark, sf), f"{d}/delta")
    return spark.read.parquet(f"{d}/base"), ingest.read_delta(spark, f"{d}/delta").drop("batch")


def test_keys_reach_both_scans(spark, layers):
    engine = api.Engine(spark, *layers, ingest.CommitmentState(300, 299, 269))
    scans = re.findall(r"PushedFilters: \[(.*)\]", plan(engine.account(42)))
    assert len(scans) == 2 and all("EqualTo(pubkey,42)" in s for s in scans)
    scans = re.findall(r"PushedFilters: \[(.*)\]", plan(engine.multiple_accounts([1, 2, 3])))
    assert len(scans) == 2 and all("In(pubkey, [1,2,3])" in s for s in scans)


def test_program_filters_reach_the_base_scan(spark, layers):
    engine = api.Engine(spark, *layers, ingest.CommitmentState(300, 299, 269))
    assert "EqualTo(owner,BUILDING)" in plan(engine.of_program("BUILDING"))


@pytest.mark.parametrize("owner", ["BUILDING", "1-URGENT", "nobody"])
@pytest.mark.parametrize("level", ["processed", "finalized"])
def test_programs_through_a_delta_equal_the_merge(spark, layers, owner, level):
    engine = api.Engine(spark, *layers, ingest.CommitmentState(300, 299, 150))
    cols = ["pubkey", "slot", "write_version", "owner"]
    want = engine.accounts(level).where(F.col("owner") == owner).select(cols).collect()
    assert sorted(engine.of_program(owner, level=level).select(cols).collect()) == sorted(want)


def test_a_base_row_can_be_newer_than_the_delta(spark):
    kind = "pubkey int, owner string, slot long, write_version long, storage_type string"
    base = spark.createDataFrame([(1, "a", 50, 0, "base"), (2, "a", 5, 0, "base"), (3, "b", 5, 7, "compacted")], kind)
    delta = spark.createDataFrame([(1, "a", 40, 9, "delta"), (2, "b", 6, 0, "delta"), (3, "a", 5, 7, "delta"), (4, "a", 1, 0, "delta"), (4, "b", 99, 0, "delta")], kind)
    engine = api.Engine(spark, base, delta, ingest.CommitmentState(60, 60, 60))
    for owner in "ab":
        want = {tuple(r) for r in engine.accounts().where(F.col("owner") == owner).collect()}
        assert {tuple(r) for r in engine.of_program(owner).collect()} == want and len(want)


def test_slot_buckets_are_pruned(spark, layers):
    for df in (versions.visible(layers[1], 300), versions.slot_range(layers[1], 10, 20)):
        assert re.search(r"PartitionFilters: \[.*slot_bucket", plan(df))


def test_history_of_a_hot_key_is_cut_before_the_shuffle(spark, sf):
    assert plan(versions.history(views.upd_events(spark, sf), 3)).count("WindowGroupLimit") >= 2


def test_keys_are_literals_without_a_second_scan(spark, sf):
    out = plan(P.multiple_accounts(spark, views.blob_docs(spark, sf), [5, -1, 7, 5]))
    assert out.count("In(doc_id, [") >= 1 and len(re.findall(r"\(\d+\) Scan parquet", out)) == 1


def segment(n, slot):
    return segments.pack_segment([(slot, i, bytes([n]) * 32, b"x") for i in range(n)], slot)


def test_a_late_segment_with_a_smaller_name_is_read_once(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSource)
    src, out = f"{tmp_path}/segments", f"{tmp_path}/out"
    os.makedirs(src)
    for name, n in (("b.seg", 2), ("a.seg", 3), ("c.seg", 1)):
        with open(f"{src}/{name}", "wb") as f:
            f.write(segment(n, 10 * n))
        ingest.drain(spark.readStream.format("delta_segment").load(src), out, "append")
    assert spark.read.parquet(out).groupBy("segment").count().orderBy("segment").collect() == [("a.seg", 3), ("b.seg", 2), ("c.seg", 1)]


def test_headers_with_a_flipped_byte_are_refused():
    good = segment(2, 5)
    assert segments.segment_info(good)["entry_count"] == 2
    for at in range(44):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            segments.segment_info(bytes(bad))
    assert zlib.crc32(good[:40] + bytes(4)) == segments.segment_info(good)["checksum"]


def test_segment_writer_rolls_and_fails_when_full(tmp_path):
    rows = [SimpleNamespace(slot=i, write_version=0, pubkey=bytes(32), data=b"d" * 10) for i in range(25)]
    w = segments.Writer({"path": str(tmp_path), "roll": "10"})
    w.commit([w.write(iter(rows)), None], 3)
    w.commit([w.write(iter(rows))], 3)  # the same batch once more
    assert [segments.segment_info(open(p, "rb").read())["entry_count"] for p in segments._files(str(tmp_path))] == [10, 10, 5]
    with pytest.raises(ValueError, match="full"):
        segments.Writer({"path": str(tmp_path), "capacity": "2000"}).write(iter(rows))
    lost = w.write(iter(rows))
    w.abort([lost, None], 4)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("_")]
    assert segments.remove_through(str(tmp_path), 9) == ["batch-000000000003-000000.seg"]
    assert len(segments._files(str(tmp_path))) == 2


def test_record_fields_and_ranges():
    raw = records.pack_record(b"k" * 32, b"o" * 32, b"data!", lamports=7, slot=9, executable=True)
    got = {n: records.read_field(raw, 0, n) for n in [*records.FIELDS, "data_len"]}
    assert got == {"stored_size": 102, "pubkey": b"k" * 32, "owner": b"o" * 32, "executable": True, "rent_epoch": 0, "lamports": 7, "slot": 9, "data_len": 5}
    assert records.read_field(raw, 8, "slot") is None and not records.is_record(raw[:50], 0) and not records.is_record(raw, -1)
    assert records.data_at(raw, {"offset": 0, "data_offset": 97, "data_len": 5}) == b"data!"
    with pytest.raises(ValueError):
        records.read_range(raw, 100, 10)


def test_a_cluster_must_name_its_shared_folder():
    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))
    assert shared.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.shared_dir(session("local[4]", None)).startswith("file:")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master, None))


def test_dictionary_keeps_ids_that_are_stored(spark, tmp_path):
    known = sets.PersistentDictionary(spark, f"{tmp_path}/d", "owner", "string")
    rows = lambda *r: spark.createDataFrame(list(r), "owner string, at int")
    assert known.grow(rows(("x", 3), ("y", 1)), "at") == 2 and known.grow(rows(("a", 0), ("x", 0)), "at") == 1
    again = sets.PersistentDictionary(spark, f"{tmp_path}/d", "owner", "string")
    assert {tuple(r) for r in again.table().collect()} == {("y", 1), ("x", 2), ("a", 3)}
    assert {tuple(r) for r in again.ids_of(spark.createDataFrame([("a",), ("q",)], "owner string")).collect()} == {("a", 3), ("q", None)}
    assert [r.owner for r in again.keys_of(spark.createDataFrame([(2,)], "id long")).collect()] == ["x"]


def test_a_removed_id_that_is_inserted_again_is_back(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    log = sets.log_entries(ids(2, 3), 1, False).unionByName(sets.log_entries(ids(2, 9), 2)).unionByName(sets.log_entries(ids(9), 3, False))
    assert sorted(r.id for r in sets.layered(ids(1, 2, 3), log).collect()) == [1, 2]
    base, rest = sets.compact_log(ids(1, 2, 3), log, 1)
    assert sorted(r.id for r in base.collect()) == [1] and sorted(r.id for r in sets.layered(base, rest).collect()) == [1, 2]


def test_bits_and_merges(spark):
    row = spark.range(1).select(sets.first_set(F.array(F.lit(0).cast("long"), F.lit(-1 << 63).cast("long"))).alias("first"), sets.first_set(F.array(F.lit(0).cast("long"))).alias("none"), sets.merge_sorted(F.array(*map(F.lit, (1, 1, 3))), F.array(*map(F.lit, (1, 2, 3)))).alias("merged")).first()
    assert (row["first"], row["none"], row["merged"]) == (127, None, [1, 1, 2, 3])


def test_layered_cache_moves_entries(tmp_path):
    now = [0.0]
    c = cache.LayeredCache(str(tmp_path), most_recent=1, most_used=2, ttl=10, clock=lambda: now[0])
    for k in "abc":
        c.put(k, {"v": k}, slot=1)
    assert len(os.listdir(tmp_path)) == 1 and c.get("a") == {"v": "a"} and c.hits[3] == 1
    assert c.get("a") == {"v": "a"} and c.hits[1] == 1 and c.get("zzz") is None
    now[0] = 11.0
    assert c.get("a") is None and c.hit_rate == 0.5
    c.put("n", 1, slot=500)
    assert c.invalidate_by_slot(500) == 2 and c.get("n") == 1


def test_point_cache_serves_only_the_slot_asked_for():
    c = cache.PointCache()
    c.put(("k", "base64"), 1, slot=5)
    assert c.get(("k", "base64"), 5) == 1 and c.get(("k", "base64"), 6) is None and not c.by_account
    c.put(("k", "x"), 1, slot=5)
    c.put(("k", "y"), 1, slot=5)
    assert c.invalidate("k", "other") == 2 and not c.entries and c.stats()["entries"] == 0


def test_answers_follow_the_state(spark):
    key, rows = bytes(range(32)), []
    for slot in (5, 8):
        rows.append((bytearray(key), slot, slot, bytearray(b"d"), bytearray(32), False, 0))
    delta = spark.createDataFrame(rows, "pubkey binary, slot long, lamports long, data binary, owner binary, executable boolean, rent_epoch long").withColumns({"write_version": F.lit(0).cast("long"), "storage_type": F.lit("delta")})
    base = delta.limit(0).withColumn("storage_type", F.lit("base"))
    engine = api.Engine(spark, base, delta, ingest.CommitmentState(6, 5, 0))
    ask = lambda: engine.rpc({"id": 1, "method": "getAccountInfo", "params": [api.codecs.base58_encode(key)]})["result"]
    assert ask()["value"]["lamports"] == 5 and ask()["context"]["slot"] == 6
    engine.state.observe(9)
    assert ask()["value"]["lamports"] == 8
    engine.changed([key])
    assert not engine.cache.entries


def test_rate_limiter_forgets_silent_clients():
    now = [0.0]
    limiter = api.RateLimiter(1, clock=lambda: now[0], most_clients=3)
    assert all(limiter.allow(f"c{i}") for i in range(4)) and not limiter.allow("c0")
    now[0] = 2.0
    assert limiter.allow("c9") and len(limiter.calls) == 1


def test_lag_listener_warns():
    head = [100]
    listener = ingest.LagListener(lambda: head[0], lambda: 30)
    event = SimpleNamespace(progress=SimpleNamespace(name="ingest", batchId=4))
    listener.onQueryProgress(event)
    head[0] = 94
    listener.onQueryProgress(event)
    assert list(listener.warnings) == [("ingest", 4, 70)]


def test_materialized_places_are_compared(spark, sf):
    a = P.with_index_columns(views.blob_parts(spark, sf), [(1, 4)])
    assert "at_1_4" in str(P.Memcmp(1, b"ed w").column(set(a.columns))._jc) and a.where(P.Memcmp(1, b"ed w").column(set(a.columns))).count() == a.where(P.Memcmp(1, b"ed w").column(set())).count() > 0


def test_streamed_roots_equal_the_tree_by_levels(spark):
    from acctframe.functions import codecs

    for n in (1, 2, 3, 5, 8, 13, 100):
        rows = spark.range(n, numPartitions=3).select(F.lit("g").alias("g"), F.lpad(F.col("id").cast("string"), 4, "0").cast("binary").alias("pubkey"), F.lit(bytearray(b"d")).alias("data"))
        leaves = [bytes(r.h) for r in rows.orderBy("pubkey").select(C.account_hash().alias("h")).collect()]
        assert stats.merkle_roots(rows, "g").first().root == codecs.merkle_root(leaves).hex()


def test_filters_are_ordered_by_selectivity():
    d, m, s = P.Discriminator(b"12345678"), P.Memcmp(0, b"a"), P.DataSize(1)
    assert planner.by_selectivity([s, m, d]) == [d, m, s]
    assert [planner.column_of(f) for f in (s, m, d, P.TokenField("mint", b""))] == ["data_len", "data[0:1]", "discriminator", "mint"]


def plain_blake3(text):
    """The hash by its recursive definition, on Python integers."""
    from acctframe.functions import blake3 as B

    mask, iv = (1 << 32) - 1, [int(x) for x in B.IV]

    def compress(cv, block, counter, size, flags):
        m = [int.from_bytes(block[4 * i : 4 * i + 4], "little") for i in range(16)]
        v = [*cv, *iv[:4], counter & mask, counter >> 32, size, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(B.MIXED):
                for x, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & mask
                    v[d] ^= v[a]
                    v[d] = (v[d] >> r1 | v[d] << 32 - r1) & mask
                    v[c] = (v[c] + v[d]) & mask
                    v[b] ^= v[c]
                    v[b] = (v[b] >> r2 | v[b] << 32 - r2) & mask
            m = [m[p] for p in B.PERMUTED]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def raw(cv):
        return b"".join(x.to_bytes(4, "little") for x in cv)

    def node(t, counter, root):
        if len(t) <= 1024:
            cv, blocks = iv, [t[i : i + 64] for i in range(0, len(t), 64)] or [b""]
            for i, b in enumerate(blocks):
                end = i == len(blocks) - 1
                cv = compress(cv, b.ljust(64, b"\0"), counter, len(b), (i == 0) | 2 * end | 8 * (end and root))
            return cv
        left = 1024
        while 2 * left < len(t):
            left *= 2
        return compress(iv, raw(node(t[:left], counter, False)) + raw(node(t[left:], counter + left // 1024, False)), 0, 64, 4 | 8 * root)

    return raw(node(text, 0, True))


def test_blake3(spark):
    from acctframe.functions import blake3 as B

    assert [d.hex() for d in B.digests([b"", b"abc"])] == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]
    texts = [bytes((i * 7 + n) % 251 for i in range(n)) for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 8193)]
    assert B.digests(texts) == [plain_blake3(t) for t in texts]
    rows = spark.createDataFrame([(0, bytearray(b"ab"), bytearray(b"c")), (1, None, None)], "i int, pubkey binary, data binary")
    got = rows.select("i", B.account_blake3().alias("h")).orderBy("i").collect()
    assert bytes(got[0].h) == B.digests([b"abc"])[0] and got[1].h is None

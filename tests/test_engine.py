"""The engine's queries against DuckDB, and its codecs, sources, planner, paging, streams, caches and interface."""

import hashlib
import math
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from acctframe import api, cache, catalog, schemas
from acctframe.functions import codecs
from acctframe.functions import columns as C
from acctframe.operators import predicates as P
from acctframe.operators import sets, stats, versions
from acctframe.plans import paging, planner
from acctframe.sources import records, segments
from acctframe.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    clean = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    df, want = catalog.queries()[name](spark, sf), duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["sort_lamports", "sort_data_size", "sort_slot_desc"])
def test_sorts_are_whole_and_in_order(spark, sf, duck, name):
    want = duck.sql(catalog.oracle_sql()[name]).fetchall()
    assert len(want) > 100 and [tuple(r) for r in catalog.queries()[name](spark, sf).collect()] == want


def key(n):
    return bytes([n]) * 32


@pytest.fixture
def accounts(spark):
    rows = [(bytearray(key(i)), 1000 * i, bytearray(bytes([i % 3]) * (5 + i % 4)), bytearray(key(100 + i % 2)), False, i, 0, 0, "base", None) for i in range(1, 31)]
    return spark.createDataFrame([(*r[:1], __import__("decimal").Decimal(r[1]), *r[2:7], __import__("decimal").Decimal(0), *r[8:]) for r in rows], schemas.ACCOUNTS)


def test_version_order(spark):
    v = spark.createDataFrame([(1, 100, 1), (1, 100, 2), (1, 101, 1), (2, 5, 9)], "pubkey int, slot long, write_version long")
    assert {(r.pubkey, r.slot, r.write_version) for r in versions.latest(v).collect()} == {(1, 101, 1), (2, 5, 9)}
    layers = v.limit(1).select("pubkey", "slot", "write_version").crossJoin(spark.createDataFrame([("base",), ("delta",), ("compacted",)], "storage_type string"))
    assert [r.storage_type for r in versions.latest(layers, layer="storage_type").collect()] == ["delta"]
    newer_base = spark.createDataFrame([(7, 50, 0, "base")], "pubkey int, slot long, write_version long, storage_type string")
    older_delta = spark.createDataFrame([(7, 40, 3, "delta")], "pubkey int, slot long, write_version long, storage_type string")
    assert versions.merge_delta(newer_base, older_delta).first().storage_type == "base"


def test_commitment_and_rollback(spark):
    s = ingest.CommitmentState()
    s.observe(100)
    assert (s.processed, s.confirmed, s.finalized) == (100, 99, 69)
    s.observe(200)
    assert (s.processed, s.confirmed, s.finalized, s.parent) == (200, 199, 169, 100) and not s.update("processed", 150)
    s = ingest.CommitmentState(processed=110, confirmed=108, finalized=105, root=105)
    s.roll_back(102, seq=10)
    assert (s.root, s.finalized, s.processed, len(s.rollbacks)) == (102, 102, 110, 1)
    delta = spark.createDataFrame([(101, 1), (103, 2), (103, 11)], "slot long, seq long")
    assert {tuple(r) for r in s.visible_delta(delta, "seq").collect()} == {(101, 1), (103, 11)}
    assert ingest.CommitmentState.load(s.dump()) == s and s.is_visible(102, "finalized") and not s.is_visible(103, "finalized")
    assert s.advance() == 111 and s.update_root(104) == 102 and s.lagging(200) and not s.lagging(120)
    assert ingest.compaction_due(10, 0) and ingest.compaction_due(0, 100_000) and not ingest.compaction_due(9, 99_999)
    assert ingest.PostingLayers(deltas=4).due() and not ingest.PostingLayers().due()


def test_codecs():
    assert codecs.base58_encode(b"\0\0hello") == "11Cn8eVZg" and codecs.base58_decode("11Cn8eVZg") == b"\0\0hello"
    assert codecs.base58_decode(C.TOKEN_PROGRAM)[:4] == bytes([6, 221, 246, 225])
    place = {"file_id": 1, "offset": 1000, "stored_size": 120, "data_offset": 20, "data_len": 100, "slot": 100, "write_version": 1, "storage_type": "compacted"}
    raw = codecs.pack_place(**place)
    assert len(raw) == 45 and codecs.unpack_place(raw) == place
    with pytest.raises(ValueError):
        codecs.unpack_place(raw[:44])
    for n in range(1, 10):
        leaves = [codecs.node_hash(bytes([i]), b"") for i in range(n)]
        root = codecs.merkle_root(leaves)
        for i in range(n):
            assert codecs.merkle_verify(leaves[i], codecs.merkle_proof(leaves, i), root)
            assert n == 1 or not codecs.merkle_verify(leaves[i - 1], codecs.merkle_proof(leaves, i), root)
    assert codecs.merkle_root([]) is None
    assert codecs.decode_cursor(codecs.encode_cursor(a=1)) == {"a": 1} and codecs.decode_cursor("?!") is None and codecs.decode_cursor(None) is None
    assert codecs.decode_bytes("0x1234567890abcdef") == bytes.fromhex("1234567890abcdef") == codecs.decode_bytes("EjRWeJCrze8=", "base64")


def test_u64_is_exact(spark):
    raw = struct.pack("<IQ", 7, 2**64 - 1)
    r = spark.createDataFrame([(bytearray(raw),), (bytearray(b"abc"),)], "data binary").select(C.le_uint("data", 4, 8).alias("v")).collect()
    assert [x.v for x in r] == [2**64 - 1, None]


def test_base_files(spark, tmp_path):
    for f in range(3):
        body = b"".join(records.pack_record(key(10 * f + i), key(9), bytes([i]) * 100, lamports=2**64 - 1, slot=100 + f, rent_epoch=5) for i in range(10))
        (tmp_path / f"{f:024}.bin").write_bytes(body + struct.pack("<Q", 0) + b"rest")
    (tmp_path / "notes.txt").write_bytes(b"x" * 200)
    spark.dataSource.register(records.AccountsSource)
    df = spark.read.format("accounts").load(str(tmp_path))
    assert df.count() == 30 and df.schema == schemas.ACCOUNTS and df.rdd.getNumPartitions() == 3
    one = records.locate(df, key(12)).first()
    assert one.lamports == 2**64 - 1 and one.location.offset == 2 * 200 and one.slot == 101 and len(one.data) == 100
    other = records.scan(spark, str(tmp_path))
    assert sorted(bytes(r.pubkey) for r in other.select("pubkey").collect()) == sorted(key(i) for i in range(30))
    assert records.scan_stats(df).first()[:3] == (3, 30, 30 * 197)
    assert records.at_offset(df, 1, 200).first().location.data_len == 100
    out = str(tmp_path / "again")
    df.write.format("accounts").mode("append").save(out)
    assert spark.read.format("accounts").load(out).count() == 30
    records.bootstrap(spark, str(tmp_path / "0*.bin"), str(tmp_path / "base"), 2)
    assert spark.read.parquet(str(tmp_path / "base")).where(F.col("pubkey") == F.lit(bytearray(key(3)))).count() == 1


def test_records_at_the_edges():
    good = records.pack_record(key(1), key(2), b"abc")
    assert len(good) % 8 == 0 and records.padding(97) == 7 and records.aligned(96) == 96
    short = struct.pack("<Q", 16) + b"\0" * 8
    assert len(list(records.parse_file(0, short + good))) == 1
    assert list(records.parse_file(0, good + struct.pack("<Q", 10_000))) and not list(records.parse_file(0, b"1234"))
    head = struct.pack("<II", 0xC0000000, 0)
    assert records.has_header(head) and not records.has_header(good)
    assert len(list(records.parse_file(0, head + good, "auto"))) == 1 and len(list(records.parse_file(0, good, "auto"))) == 1
    assert records.file_id("/x/000012.34") == 12 and records.file_id("abc.1") is None and records.file_id("12") is None


def test_segments(spark, tmp_path):
    raw = segments.pack_segment([(100, 1, key(1), b"test account data"), (101, 2, key(1), b"x")], 100)
    info = segments.segment_info(raw)
    assert (info["start_slot"], info["end_slot"], info["entry_count"], info["data_size"]) == (100, 101, 2, 64 + 17 + 65)
    with pytest.raises(ValueError):
        segments.segment_info(b"\0" * 48)
    (tmp_path / "a.seg").write_bytes(raw)
    spark.dataSource.register(segments.SegmentSource)
    df = spark.read.format("delta_segment").load(str(tmp_path))
    assert [tuple(r)[:2] for r in df.orderBy("slot").collect()] == [(100, 1), (101, 2)]
    c = segments.catalog(df).first()
    assert (c.entry_count, c.start_slot, c.end_slot, c.data_size) == (2, 100, 101, 146)
    assert versions.slot_range(segments.catalog(df), 101, 200, "start_slot", "end_slot").count() == 1
    base = spark.createDataFrame([(bytearray(key(1)), bytearray(key(8)), 5, "base")], "pubkey binary, owner binary, lamports long, storage_type string")
    assert segments.with_base_fields(df, base).select("lamports").distinct().first()[0] == 5


def test_stream_reads_each_segment_once(spark, tmp_path):
    src, delta = tmp_path / "in", str(tmp_path / "delta")
    src.mkdir()
    spark.dataSource.register(segments.SegmentSource)
    seen = []
    for n in range(2):
        (src / f"{n}.seg").write_bytes(segments.pack_segment([(100 + n, i, key(i % 2), b"d") for i in range(4)], 100))
        stream = spark.readStream.format("delta_segment").load(str(src))
        ingest.start_ingest(stream, delta, str(tmp_path / "ckpt"), on_batch=lambda b, i: seen.append(b.count()), once=True).awaitTermination()
    rows = ingest.read_delta(spark, delta)
    assert seen == [4, 4] and rows.count() == 4 and {r.slot_bucket for r in rows.collect()} == {0}
    assert {r.write_version for r in versions.latest(rows).collect()} == {2, 3}


def test_compaction_keeps_later_rows(spark, tmp_path):
    base = spark.createDataFrame([(1, 10, 0, 5, "base"), (2, 10, 0, 6, "base")], "pubkey int, slot long, write_version long, lamports long, storage_type string")
    delta = spark.createDataFrame([(1, 20, 1, 7, "delta"), (3, 30, 2, 8, "delta")], base.schema)
    base.write.parquet(f"{tmp_path}/b")
    ingest.with_layout(delta).write.partitionBy(*ingest.LAYOUT).parquet(f"{tmp_path}/d")
    assert ingest.compact_to(spark, f"{tmp_path}/b", f"{tmp_path}/d", f"{tmp_path}/b2", f"{tmp_path}/d2", 25, 1) == 1
    assert {(r.pubkey, r.lamports, r.storage_type) for r in spark.read.parquet(f"{tmp_path}/b2").collect()} == {(1, 7, "compacted"), (2, 6, "compacted")}
    assert [r.pubkey for r in spark.read.parquet(f"{tmp_path}/d2").collect()] == [3]


def test_planner():
    disc, mem, size = P.Discriminator(bytes(8)), P.Memcmp(32, bytes([1, 2, 3])), P.DataSize(165)
    s = planner.Statistics({"p": 1000}, {165: 500}, {bytes(8): 50}, {(32, bytes([1, 2, 3])): 100})
    p = planner.plan(s, "p", [size, mem, disc])
    assert p.order == [disc, mem, size, "program"] and p.intermediate == [50, 50, 50, 50] and p.cost == 40 + 150 + 100
    assert planner.cardinality(s, disc) == (50, 0.95) and planner.cardinality(s, P.DataSize(1)) == (0, 0.5)
    assert planner.plan(s, "other", []).cardinalities == [planner.UNKNOWN_PROGRAM]
    assert planner.estimate(5, []).cardinality == 5 and planner.estimate(1000, [size]).cardinality == 100
    e = planner.estimate(100_000, [size, mem])
    assert (e.cardinality, e.total_cost, e.streaming) == (501, 100 + 30 + 501 + 5010, False)  # the product of shares is a little over 0.005


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(25)], "pubkey long, lamports long")
    for order in ("pubkey", "lamports"):
        sizes, cursor, seen = [], None, []
        while True:
            p = paging.page(df, 10, cursor, order)
            sizes.append(len(p.rows))
            seen += [r.pubkey for r in p.rows]
            cursor = p.next_cursor
            if cursor is None:
                break
        assert sizes == [10, 10, 5] and sorted(seen) == list(range(25)) and not p.has_more and p.is_last_page
    assert paging.page(df, 25).next_cursor and not paging.page(df, 25).has_more
    assert paging.clamp(None) == 100 and paging.clamp(5000) == 1000 and [r.pubkey for r in paging.page(df, 3, "broken").rows] == [0, 1, 2]
    assert paging.offset_page(df, 30, 5).count() == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((1, 2, 3), (2, 3, 4)))
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(sets.intersect(a, b)) == [2, 3] and ids(sets.union(a, b)) == [1, 2, 3, 4] and ids(sets.difference(a, b)) == [1]
    assert ids(sets.symmetric_difference(a, b)) == [1, 4] and ids(sets.with_deltas(a, [b], b.where("id = 3"))) == [1, 2, 4]
    assert sets.overlap(a, b).first().jaccard == 0.5 and sets.overlap(a.limit(0), b.limit(0)).first().jaccard == 0
    r = spark.range(1).select(sets.popcount(F.array(F.lit(15), F.lit(10), F.lit(3))).alias("n"), sets.words_or(F.array(F.lit(1), F.lit(2)), F.array(F.lit(4))).alias("w"), sets.words_and(F.array(F.lit(7), F.lit(2)), F.array(F.lit(5))).alias("x"), sets.merge_sorted(F.array(F.lit(1), F.lit(4)), F.array(F.lit(2), F.lit(4))).alias("m")).first()
    assert (r.n, r.w, r.x, r.m) == (8, [5, 2], [5], [1, 2, 4])
    posts = sets.to_bitmaps(spark.createDataFrame([("a", 1), ("a", 100), ("a", 40000), ("b", 100), ("b", 40000)], "k string, id long"), "k")
    assert sets.bitmap_size(sets.bitmap_and(posts, ["a", "b"], "k")).first().n == 2 and sets.bitmap_size(sets.bitmap_or(posts, ["a", "b"], "k")).first().n == 3
    assert sets.bitmap_size(sets.bitmap_and(posts, ["a", "c"], "k")).first().n == 0


def test_bitmaps_give_their_ids(spark):
    want = [1, 2, 8, 9, 128, 32768, 32769, 40000, 100_000]
    bitmaps = sets.to_bitmaps(spark.createDataFrame([(i,) for i in want], "id long"))
    assert sorted(r.id for r in sets.bitmap_ids(bitmaps).collect()) == want and sets.bitmap_first(bitmaps).first().id == 1
    assert sets.bitmap_first(bitmaps.where("bucket > 1")).first().id == 32769 and sets.bitmap_first(bitmaps.limit(0)).first().id is None


def test_statistics(spark, accounts):
    assert stats.hit_rate(spark.createDataFrame([], "hit boolean")).first().hit_rate == 0
    assert stats.mean_time(spark.createDataFrame([(3,), (4,)], "t long"), "t").first().mean_time == 3
    assert spark.range(1).select(stats.moving_mean(F.array(F.lit(4.0), F.lit(2.0))).alias("m")).first().m == 2.0
    assert stats.ordered_hash(accounts, "owner").count() == 2
    t = spark.createDataFrame([(1000, 1050), (1000, 2000), (1000, 15000)], "a long, b long").select(C.tier(F.col("a"), F.col("b")).alias("t"))
    assert [r.t for r in t.collect()] == ["hot", "warm", "cold"]
    assert spark.range(1).select(C.satisfies(F.lit("finalized"), "confirmed").alias("x"), C.min_confirmations(F.lit("finalized")).alias("n")).first()[:] == (True, 31)
    log = spark.createDataFrame([("owner", 200_000)] * 5000 + [("slot", 5)], "column string, scanned long")
    assert [r.column for r in planner.advise_from_log(log).collect()] == ["owner"]


def test_roots_and_projections(spark, accounts):
    rows = sorted(accounts.collect(), key=lambda r: bytes(r.pubkey))
    want = {}
    for owner in (key(100), key(101)):
        leaves = [hashlib.sha256(bytes(r.pubkey) + bytes(r.data)).digest() for r in rows if bytes(r.owner) == owner]
        want[owner] = codecs.merkle_root(leaves).hex()
    assert {bytes(r.owner): r.root for r in stats.merkle_roots(accounts, "owner").collect()} == want
    assert "data" not in P.metadata(accounts).columns and P.metadata(accounts).agg(F.max("data_len")).first()[0] == 8
    r = P.response_rows(accounts, "base58").orderBy("slot").first()
    assert r.pubkey == codecs.base58_encode(key(1)) and codecs.base58_decode(r.data) == bytes([1]) * 6 and r.space == 6
    known = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id long")
    more = sets.extend_dictionary(known, spark.createDataFrame([("b", 1), ("d", 3), ("c", 4)], "k string, seen long"), "k", "seen")
    assert {r.k: r.id for r in more.collect()} == {"a": 1, "b": 2, "d": 3, "c": 4}


def test_caches(spark, tmp_path):
    now = [0.0]
    c = cache.PointCache(2, clock=lambda: now[0])
    c.put(("a", "base64", "processed"), 1, slot=100)
    assert c.get(("a", "base64", "processed")) == 1 and c.get(("a", "base58", "processed")) is None and c.hit_rate == 0.5
    now[0] = 61
    assert c.get(("a", "base64", "processed")) is None
    for k in "xyz":
        c.put((k,), k, slot=100)
    assert c.get(("x",)) is None and c.invalidate_by_slot(200) == 0 and c.invalidate_by_slot(201) == 2
    c.put(("p",), 1, slot=5, ttl=0)
    assert c.get(("p",)) is None
    e = cache.Entry(1, 0, 1, 100, 5)
    assert e.older_than(101, 0) and e.older_than(100, 6) and not e.older_than(100, 5)
    for strategy in ("immediate", "lazy"):
        store = cache.ResultStore(spark, f"{tmp_path}/{strategy}", strategy)
        for q, ids in (("q1", range(5)), ("q2", range(3, 8)), ("q3", [99])):
            store.put(q, spark.createDataFrame([(i,) for i in ids], "pubkey long"), slot=100)
        assert store.get("q1", 100).count() == 5
        store.changed(spark.createDataFrame([(3,), (4,)], "pubkey long"))
        assert store.get("q1", 100) is None and store.get("q2", 100) is None and store.get("q3", 200).count() == 1 and store.get("q3", 201) is None


def test_interface(spark, accounts):
    state = ingest.CommitmentState()
    state.observe(40)
    e = api.Engine(spark, accounts, state=state)
    k5, owner = codecs.base58_encode(key(5)), codecs.base58_encode(key(101))
    call = lambda method, *params: e.rpc({"jsonrpc": "2.0", "method": method, "params": list(params), "id": 1})
    got = call("getAccountInfo", k5, {"encoding": "base58"})
    assert got["result"]["value"]["lamports"] == 5000 and got["result"]["context"]["slot"] == 40 and got["id"] == 1
    assert call("getAccountInfo", k5, {"commitment": "finalized"})["result"]["value"]["slot"] == 5
    assert call("getAccountInfo", codecs.base58_encode(key(20)), {"commitment": "finalized"})["result"]["value"] is None
    two = call("getMultipleAccounts", [k5, codecs.base58_encode(key(77))])["result"]["value"]
    assert two[0]["space"] == 6 and two[1] is None
    assert call("nope", 1)["error"]["code"] == api.NO_METHOD and call("getAccountInfo", "0OIl")["error"]["code"] == api.BAD_PARAMS
    assert e.rpc({"method": "getAccountInfo", "params": "x"})["error"]["code"] == api.BAD_PARAMS and e.rpc("x")["error"]["code"] == api.PARSE
    assert len(call("getProgramAccounts", owner)["result"]["value"]) == 15
    some = call("getProgramAccounts", owner, {"filters": [{"dataSize": 6}, {"memcmp": {"offset": 0, "bytes": "0x02"}}]})["result"]["value"]
    assert some and all(a["space"] == 6 for a in some)
    page = call("getProgramAccountsV2", owner, {"limit": 10})["result"]
    rest = call("getProgramAccountsV2", owner, {"limit": 10, "cursor": page["cursor"]})["result"]
    assert (len(page["accounts"]), page["hasMore"], len(rest["accounts"]), rest["cursor"]) == (10, True, 5, None)
    assert call("getTokenAccountsByOwner", k5)["result"]["value"] == []
    assert e.health()["slot"] == 40 and "requests_total" in e.metrics() and e.query_log().count() >= 4
    assert e.explain(key(101), [P.DataSize(6)]).order[0] == P.DataSize(6)
    now = [0.0]
    limiter = api.RateLimiter(5, clock=lambda: now[0])
    assert [limiter.allow("a") for _ in range(6)] == [True] * 5 + [False] and limiter.allow("b")
    now[0] = 1.0
    assert limiter.allow("a")


def test_filters_push_down(spark, accounts, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    P.with_index_columns(accounts).write.parquet(f"{tmp_path}/a")
    df = P.program_accounts(spark.read.parquet(f"{tmp_path}/a"), key(101), [P.DataSize(6), P.Discriminator(bytes(8))]).select("pubkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(data_len,6)" in plan and "EqualTo(owner" in plan and "EqualTo(discriminator" in plan and "lamports" not in plan.split("ReadSchema")[1]


def test_entry_works_without_the_optional_part():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(__file__))
    code = "import sys; sys.modules['acctframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'gpa_program' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).returncode == 0


def test_jobs(spark, tmp_path):
    from acctframe import jobs

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "1.0").write_bytes(records.pack_record(key(1), key(2), b"abc", slot=7))
    jobs.main(["bootstrap", str(tmp_path / "files"), str(tmp_path / "base"), "--partitions", "1"], spark)
    assert [r.slot for r in spark.read.parquet(str(tmp_path / "base")).collect()] == [7]
    (tmp_path / "segments").mkdir()
    (tmp_path / "segments" / "a.seg").write_bytes(segments.pack_segment([(8, 1, key(1), b"new"), (9, 2, key(3), b"x")], 8))
    jobs.main(["ingest", str(tmp_path / "segments"), str(tmp_path / "delta"), str(tmp_path / "ckpt")], spark)
    assert spark.read.parquet(str(tmp_path / "delta")).count() == 2
    jobs.main(["compact", *[str(tmp_path / n) for n in ("base", "delta", "base2", "delta2")], "--root", "8", "--partitions", "1"], spark)
    assert [(r.slot, bytes(r.data)) for r in spark.read.parquet(str(tmp_path / "base2")).collect()] == [(8, b"new")]
    jobs.main(["stats", str(tmp_path / "files")], spark)

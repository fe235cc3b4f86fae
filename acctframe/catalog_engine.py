"""Queries of the engine facade, its protocol and caches, and of functions and set operations that the first catalog leaves out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from acctframe import cache, shared, views
from acctframe.api import Engine
from acctframe.catalog import query
from acctframe.functions import codecs
from acctframe.functions import columns as C
from acctframe.operators import predicates as P
from acctframe.operators import sets, stats, versions
from acctframe.plans import paging, planner
from acctframe.streaming import ingest
from acctframe.views import base_cust, blob_docs, blob_parts, key_number, part_accounts, part_updates, upd_orders

CUTOFF = 300
STATE = f"SELECT pubkey, owner, slot, write_version, lamports, storage_type FROM (SELECT * FROM base_cust UNION ALL SELECT * FROM upd_orders) WHERE slot <= {CUTOFF} QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC, storage_type = 'delta' DESC) = 1"


def _engine(spark, d) -> Engine:
    return Engine(spark, base_cust(spark, d), upd_orders(spark, d), ingest.CommitmentState(CUTOFF, CUTOFF, CUTOFF))


def _parts_engine(spark, d) -> Engine:
    return Engine(spark, part_accounts(spark, d), part_updates(spark, d), ingest.CommitmentState(1000, 999, 969), rate=10**9)


# reads through a delta


@query(f"SELECT * FROM ({STATE}) WHERE pubkey = 42", "base_cust", "upd_orders")
def engine_account(spark, d):
    return _engine(spark, d).account(42).select("pubkey", "owner", "slot", "write_version", "lamports", "storage_type")


@query(f"SELECT CAST(pos AS BIGINT) AS pos, CAST(key AS BIGINT) AS key, s.slot, s.lamports FROM (VALUES (0, 42), (1, -1), (2, 7), (3, 42), (4, 10)) AS k(pos, key) LEFT JOIN ({STATE}) s ON s.pubkey = key", "base_cust", "upd_orders")
def engine_multiple_accounts(spark, d):
    return _engine(spark, d).multiple_accounts([42, -1, 7, 42, 10]).select("pos", "key", "slot", "lamports")


@query("SELECT DISTINCT key FROM (VALUES (42), (-1), (7), (42), (-5), (-1)) AS k(key) WHERE key < 0")
def missing_accounts(spark, d):
    return P.missing_keys(_engine(spark, d).multiple_accounts([42, -1, 7, 42, -5, -1])).select(F.col("key").cast("int").alias("key"))


@query(f"SELECT * FROM ({STATE}) WHERE owner = 'BUILDING'", "base_cust", "upd_orders")
def engine_base_program(spark, d):
    """A program that only base rows have: those that the delta supersedes are gone."""
    return _engine(spark, d).of_program("BUILDING").select("pubkey", "owner", "slot", "write_version", "lamports", "storage_type")


@query(f"SELECT * FROM ({STATE}) WHERE owner = '1-URGENT'", "base_cust", "upd_orders")
def engine_delta_program(spark, d):
    return _engine(spark, d).of_program("1-URGENT").select("pubkey", "owner", "slot", "write_version", "lamports", "storage_type")


@query("SELECT pubkey, data, slot FROM part_state WHERE owner = 'Brand#4' AND strlen(data) = 10 AND data LIKE '%i%'", "part_state")
def engine_filters(spark, d):
    """Owner and size filters over both layers; a byte match afterwards."""
    found = _parts_engine(spark, d).of_program(b"Brand#4".ljust(32), [P.DataSize(10)])
    text = F.decode("data", "UTF-8")
    return found.where(text.contains("i")).select(key_number("pubkey").alias("pubkey"), text.alias("data"), "slot")


@query("SELECT pubkey, slot FROM part_state WHERE owner = 'Brand#99'", "part_state")
def engine_rows(spark, d):
    rows = _parts_engine(spark, d).rows(b"Brand#99".ljust(32))
    return spark.createDataFrame([(int(bytes(r["pubkey"])), r["slot"]) for r in rows], "pubkey long, slot long")


# protocol


def _rpc(spark, d, method: str, *params) -> dict:
    return _parts_engine(spark, d).rpc({"jsonrpc": "2.0", "id": 1, "method": method, "params": list(params)})


def _key(n: int) -> str:
    return codecs.base58_encode(b"%032d" % n)


def _shown(spark, values: list):
    """Values of answers as rows, their texts decoded."""
    rows = [(int(codecs.base58_decode(v["pubkey"])), codecs.base58_decode(v["owner"]).decode().strip(), codecs.decode_bytes(v["data"][0], v["data"][1]).decode(), v["slot"], v["lamports"], v["space"]) for v in values]
    return spark.createDataFrame(rows, "pubkey long, owner string, data string, slot long, lamports long, space long")


RPC = "SELECT pubkey, owner, data, slot, lamports, CAST(strlen(data) AS BIGINT) AS space FROM part_state"


@query(f"{RPC} WHERE pubkey = 11", "part_state")
def rpc_account_info(spark, d):
    return _shown(spark, [_rpc(spark, d, "getAccountInfo", _key(11))["result"]["value"]])


@query(f"{RPC} WHERE pubkey IN (1, 2, 3)", "part_state")
def rpc_multiple_accounts(spark, d):
    out = _rpc(spark, d, "getMultipleAccounts", [_key(3), _key(10**9), _key(1), _key(2)], {"encoding": "base58"})["result"]
    assert out["value"][1] is None and out["context"]["slot"] == 1000
    return _shown(spark, [v for v in out["value"] if v])


@query(f"{RPC} WHERE owner = 'Brand#4' AND strlen(data) = 10", "part_state")
def rpc_program_accounts(spark, d):
    """All pages of a program query."""
    engine, rows, cursor = _parts_engine(spark, d), [], None
    program = codecs.base58_encode(b"Brand#4".ljust(32))
    while True:
        answer = engine.rpc({"jsonrpc": "2.0", "id": 1, "method": "getProgramAccounts", "params": [program, {"filters": [{"dataSize": 10}], "limit": 200, "cursor": cursor}]})["result"]
        rows += answer["value"]
        cursor = answer["context"].get("cursor")
        if not cursor:
            return _shown(spark, rows)


@query("SELECT pubkey, data FROM part_state WHERE owner = 'Brand#4' ORDER BY lamports, pubkey LIMIT 15", "part_state")
def rpc_program_accounts_v2(spark, d):
    """The first page by lamports."""
    out = _rpc(spark, d, "getProgramAccountsV2", codecs.base58_encode(b"Brand#4".ljust(32)), {"limit": 15, "sort": "lamports"})["result"]
    return _shown(spark, out["accounts"]).select("pubkey", "data")


def _token_engine(spark, d) -> Engine:
    """Line items as token accounts, their key a hash of order and line, the newest of those that share it."""
    t = views.tok_data(spark, d).withColumn("n", F.expr("pubkey * 10 + line"))
    rows = t.groupBy("n").agg(F.max("data").alias("data")).select(views.key32(F.col("n")).alias("pubkey"), F.lit(0).cast("decimal(20,0)").alias("lamports"), "data", F.lit(bytearray(codecs.base58_decode(C.TOKEN_PROGRAM))).alias("owner"), F.lit(False).alias("executable"), F.lit(1).cast("long").alias("slot"), F.lit(0).cast("long").alias("write_version"), F.lit(0).cast("decimal(20,0)").alias("rent_epoch"))
    return Engine(spark, rows, None, ingest.CommitmentState(1, 1, 1), rate=10**9)


TOKENS = "SELECT pubkey * 10 + line AS n, max({'mint': mint, 'token_owner': token_owner, 'amount': amount}) AS t FROM tok_lineitem GROUP BY 1"


def _all_pages(engine: Engine, method: str, key: str) -> list:
    rows, cursor = [], None
    while True:
        answer = engine.rpc({"jsonrpc": "2.0", "id": 1, "method": method, "params": [key, {"cursor": cursor, "encoding": "base64"}]})["result"]
        rows += answer["value"]
        cursor = answer["context"].get("cursor")
        if not cursor:
            return rows


@query(f"SELECT n FROM ({TOKENS}) WHERE t.token_owner = 3", "tok_lineitem")
def rpc_tokens_by_owner(spark, d):
    rows = _all_pages(_token_engine(spark, d), "getTokenAccountsByOwner", _key(3))
    return spark.createDataFrame([(int(codecs.base58_decode(v["pubkey"])),) for v in rows], "n long")


@query(f"SELECT n FROM ({TOKENS}) WHERE t.mint = 7", "tok_lineitem")
def rpc_tokens_by_mint(spark, d):
    rows = _all_pages(_token_engine(spark, d), "getTokenAccountsByMint", _key(7))
    return spark.createDataFrame([(int(codecs.base58_decode(v["pubkey"])),) for v in rows], "n long")


@query(f"SELECT n, CAST(t.amount AS BIGINT) AS amount FROM ({TOKENS}) WHERE t.mint = 7 ORDER BY 2 DESC, lpad(CAST(n AS VARCHAR), 32, '0') LIMIT 20", "tok_lineitem")
def rpc_largest_tokens(spark, d):
    rows = _token_engine(spark, d).rpc({"jsonrpc": "2.0", "id": 1, "method": "getTokenLargestAccounts", "params": [_key(7)]})["result"]["value"]
    return spark.createDataFrame([(int(codecs.base58_decode(v["address"])), int(v["amount"])) for v in rows], "n long, amount long")


@query("SELECT * FROM (VALUES ('no method', -32601), ('no params', -32602), ('bad key', -32602), ('bad commitment', -32602), ('no request', -32700), ('too many', -32005)) AS t(request, code)")
def rpc_errors(spark, d):
    engine = Engine(spark, part_accounts(spark, d), rate=5, clock=lambda: 0.0)
    asked = {"no method": {"method": "getBlock", "params": [1]}, "no params": {"method": "getAccountInfo"}, "bad key": {"method": "getAccountInfo", "params": ["0OIl"]}, "bad commitment": {"method": "getAccountInfo", "params": [_key(1), {"commitment": "maybe"}]}, "no request": {}, "another": {"method": "getBlock"}, "too many": {"method": "getAccountInfo", "params": [_key(1)]}}
    got = {name: engine.rpc(r)["error"]["code"] for name, r in asked.items()}
    return spark.createDataFrame([(k, c) for k, c in got.items() if k != "another"], "request string, code int")


@query("SELECT 'ok' AS status, CAST(1000 AS BIGINT) AS slot, CAST(2 AS BIGINT) AS calls, CAST(0.5 AS DOUBLE) AS hit_rate, 'pubkey' AS searched_by")
def service_report(spark, d):
    """Health, cache and query log after the same point read twice."""
    engine = _parts_engine(spark, d)
    for _ in range(2):
        engine.rpc({"id": 1, "method": "getAccountInfo", "params": [_key(5)]})
    log = engine.query_log().agg(F.count("*").alias("calls"), F.max(F.array_join("columns", ",")).alias("searched_by"))
    health = engine.health()
    return log.select(F.lit(health["status"]).alias("status"), F.lit(health["slot"]).cast("long").alias("slot"), "calls", F.lit(engine.cache.hit_rate).alias("hit_rate"), "searched_by")


@query("SELECT event_type AS \"column\", CAST(count(*) AS BIGINT) AS queries, round(avg(value), 6) AS scanned FROM events GROUP BY 1 HAVING count(*) >= 50 AND avg(value) >= 1")
def log_advice(spark, d):
    """Advice over a query log with thresholds that fit the events."""
    log = views.table(spark, d, "events").select(F.col("event_type").alias("column"), F.col("value").alias("scanned"))
    return planner.advise_from_log(log, queries=50, scanned=1).withColumn("scanned", F.round("scanned", 6))


@query("SELECT p_brand AS key, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def layout_migration(spark, d):
    """Parts migrated to bitmaps by brand, as the adviser would have them, and counted there."""
    out = shared.new_path(spark, "layout")
    rows = views.table(spark, d, "part").select(F.col("p_brand").alias("key"), (F.col("p_partkey") + 1).alias("id"))
    planner.migrate(rows, "key", "bitmap", out, 4)
    return spark.read.parquet(out).groupBy("key").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


# caches


@query("SELECT CAST(count(*) - count(DISTINCT conv_id) AS BIGINT) AS hits, CAST(count(DISTINCT conv_id) AS BIGINT) AS misses, CAST(count(DISTINCT conv_id) - 1 AS BIGINT) AS entries FROM conversations")
def point_cache(spark, d):
    """Turns as lookups of their conversation in the point cache; then one conversation changes."""
    kept = cache.PointCache()
    for (conv,) in views.table(spark, d, "conversations").select("conv_id").toLocalIterator():
        if kept.get((conv, "base64", "processed")) is None:
            kept.put((conv, "base64", "processed"), (conv,), 1)
    assert kept.invalidate(0) == 1
    return spark.createDataFrame([(kept.hits, kept.misses, len(kept.entries))], "hits long, misses long, entries long")


@query("SELECT CAST(count(*) - count(DISTINCT conv_id) AS BIGINT) AS hits, CAST(count(DISTINCT conv_id) AS BIGINT) AS misses, true AS deeper FROM conversations")
def layered_cache(spark, d):
    """The same lookups through three levels with little room in the first two: nothing is lost, and deeper levels were hit."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        kept = cache.LayeredCache(folder, most_recent=2, most_used=4)
        for (conv,) in views.table(spark, d, "conversations").select("conv_id").orderBy(F.xxhash64("conv_id", "turn")).toLocalIterator():
            if kept.get(str(conv)) is None:
                kept.put(str(conv), conv, 1)
    return spark.createDataFrame([(sum(kept.hits.values()), kept.misses, kept.hits[3] > 0)], "hits long, misses long, deeper boolean")


# pages


@query("SELECT pubkey, CAST((row_number() OVER (ORDER BY pubkey) - 1) // 10 AS BIGINT) AS page, true AS decoded FROM blob_docs WHERE owner = 'src3'", "blob_docs")
def page_walk(spark, d):
    """All pages of a program's accounts by their cursors."""
    rows, out, n, cursor, decoded = P.program_accounts(blob_docs(spark, d), "src3"), [], 0, None, True
    while True:
        p = paging.page(rows, 10, cursor)
        out += [(r.pubkey, n) for r in p.rows]
        if not p.has_more:
            return spark.createDataFrame([(*x, decoded) for x in out], "pubkey long, page long, decoded boolean")
        cursor, n = p.next_cursor, n + 1
        decoded &= codecs.decode_cursor(cursor)["key"] == p.rows[-1].pubkey and codecs.decode_cursor("no cursor") is None


@query("SELECT p_size AS asked, CAST(CASE WHEN p_size * 40 > 1000 THEN 1000 ELSE p_size * 40 END AS BIGINT) AS page FROM (SELECT DISTINCT p_size FROM part)")
def limit_clamp(spark, d):
    sizes = [r[0] for r in views.table(spark, d, "part").select("p_size").distinct().collect()]  # 50 at most
    return spark.createDataFrame([(n, paging.clamp(n * 40)) for n in sizes], "asked int, page long")


@query("SELECT source AS owner, ceil(count(*) * 0.05) > 1000 AS streaming FROM documents GROUP BY 1")
def streaming_decision(spark, d):
    counts = stats.cardinality(blob_docs(spark, d), "owner").collect()  # a row a program
    return spark.createDataFrame([(r.key, planner.estimate(r.n_accounts, [P.Memcmp(0, b"a")]).streaming) for r in counts], "owner string, streaming boolean")


# filters and functions


@query("SELECT pubkey, 'tracked' AS way FROM blob_parts WHERE owner = 'Brand#4' AND data[2:5] = encode('ed w') UNION ALL SELECT pubkey, 'data' FROM blob_parts WHERE owner = 'Brand#4' AND data[3:4] = encode('d ')", "blob_parts")
def accelerated_lookup(spark, d):
    """A byte match through the table of tracked places, and one of a place that is not tracked."""
    a, offsets = blob_parts(spark, d), [(0, 8), (1, 4)]
    tracked = P.tracked_offsets(a, offsets)
    one = P.accelerated_memcmp(a, tracked, offsets, "Brand#4", 1, b"ed w").select("pubkey", F.lit("tracked").alias("way"))
    return one.unionByName(P.accelerated_memcmp(a, tracked, offsets, "Brand#4", 2, b"d ").select("pubkey", F.lit("data").alias("way")))


@query("SELECT \"offset\", length, CAST(count(*) AS BIGINT) AS n FROM (SELECT UNNEST([0, 32, 3]) AS \"offset\", UNNEST([8, 32, 5]) AS length, data_len, owner FROM blob_docs) WHERE data_len >= \"offset\" + length AND owner <> 'src3' GROUP BY ALL", "blob_docs")
def preset_places(spark, d):
    """Places of the default presets and of a custom one, without a program's accounts that were removed."""
    a = blob_docs(spark, d)
    tracked = P.tracked_offsets(a, P.preset_offsets(custom=[(3, 5), (7, 0)]))
    kept = P.without_accounts(tracked, a.where("owner = 'src3'"))
    return kept.groupBy(F.col("offset").cast("int").alias("offset"), F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS pubkey, base64(encode(p_name)) AS data, CAST(strlen(p_name) AS BIGINT) AS space, lower(hex(encode(lpad(CAST(p_partkey AS VARCHAR), 32, '0')))) AS key_hex FROM part")
def response_accounts(spark, d):
    """Accounts as responses show them; keys come back from base58."""
    r = P.response_rows(part_accounts(spark, d))
    key = codecs.from_base58("pubkey")
    return r.select(key_number(key).alias("pubkey"), "data", "space", F.lower(F.hex(key)).alias("key_hex"))


@query("SELECT pubkey, lower(hex(data)) AS data_hex, sha256(data) = sha256(encode(replace(decode(data), 'red', 'blue'))) AS intact FROM blob_parts", "blob_parts")
def verified_hashes(spark, d):
    """Data against the hash of data in which a word was changed, after base64 and back."""
    changed = F.encode(F.replace(F.decode("data", "UTF-8"), F.lit("red"), F.lit("blue")), "UTF-8")
    a = blob_parts(spark, d).withColumns({"data": F.unbase64(F.base64("data")), "expected": C.sha256(changed)})
    return a.select("pubkey", F.lower(F.hex("data")).alias("data_hex"), C.verify("data", "expected").alias("intact"))


@query("SELECT p_partkey AS pubkey, sha256(least(p_brand, p_name) || '&' || greatest(p_brand, p_name)) AS key, true AS same FROM part")
def query_keys(spark, d):
    """A query's key does not depend on the order of its filters."""
    p = views.table(spark, d, "part")
    one, two = C.query_key([F.col("p_brand"), F.col("p_name")]), C.query_key([F.col("p_name"), F.col("p_brand")])
    return p.select(F.col("p_partkey").alias("pubkey"), one.alias("key"), (one == two).alias("same"))


def _places(frames):
    for frame in frames:
        raw = [codecs.pack_place("delta", file_id=int(n), offset=int(n) * 8, stored_size=97, data_offset=97, data_len=0, slot=int(s), write_version=1) for n, s in zip(frame["p_partkey"], frame["p_size"], strict=True)]
        back = [codecs.unpack_place(r) for r in raw]
        yield pd.DataFrame({"file_id": [b["file_id"] for b in back], "offset": [b["offset"] for b in back], "slot": [b["slot"] for b in back], "storage_type": [b["storage_type"] for b in back], "n_bytes": [len(r) for r in raw]})


@query("SELECT p_partkey AS file_id, p_partkey * 8 AS \"offset\", CAST(p_size AS BIGINT) AS slot, 'delta' AS storage_type, CAST(45 AS BIGINT) AS n_bytes FROM part")
def place_codec(spark, d):
    return views.table(spark, d, "part").select("p_partkey", "p_size").mapInPandas(_places, "file_id long, offset long, slot long, storage_type string, n_bytes long")


@query("SELECT pubkey, CASE l WHEN 0 THEN slot WHEN 1 THEN slot - 1 ELSE slot - 31 END AS up_to, l >= 1 AS confirmed_or_more, CASE l WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 31 END AS confirmations, write_version FROM (SELECT *, write_version % 3 AS l FROM upd_orders WHERE slot > 31)", "upd_orders")
def commitment_levels(spark, d):
    """Watermark, strength and confirmations of a level, of orders with levels in turn."""
    u = upd_orders(spark, d).where("slot > 31").withColumn("level", F.element_at(F.array(F.lit("processed"), F.lit("confirmed"), F.lit("finalized")), (F.col("write_version") % 3 + 1).cast("int")))
    at = C.lagged_slots(F.col("slot"))
    up_to = F.coalesce(*[F.when(F.col("level") == k, C.watermark(k, at["processed"], at["confirmed"], at["finalized"])) for k in at])
    return u.select("pubkey", up_to.alias("up_to"), C.satisfies(F.col("level"), "confirmed").alias("confirmed_or_more"), C.min_confirmations(F.col("level")).alias("confirmations"), "write_version")


@query("SELECT l_orderkey, round(list_reduce(list_concat([0.0], list(l_quantity ORDER BY l_linenumber, l_quantity)), lambda a, x: (a + x) / 2), 9) AS mean FROM lineitem GROUP BY 1")
def moving_mean(spark, d):
    """Quantities of an order's lines folded one after the other."""
    t = views.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    return t.select("l_orderkey", F.round(stats.moving_mean(F.transform("lines", lambda x: x.l_quantity)), 9).alias("mean"))


LEAF = "sha256(encode(lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) || encode(n_name))"
PAIR = "sha256(unhex({}) || unhex({}))".format


@query(f"WITH l AS (SELECT n_regionkey, list({LEAF} ORDER BY n_nationkey) AS h FROM nation GROUP BY 1) SELECT n_regionkey, {PAIR(PAIR(PAIR('h[1]', 'h[2]'), PAIR('h[3]', 'h[4]')), 'h[5]')} AS root FROM l")
def merkle_root(spark, d):
    """Roots over the five nations of each region."""
    n = views.table(spark, d, "nation").select(F.encode(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), "UTF-8").alias("pubkey"), F.encode("n_name", "UTF-8").alias("data"), "n_regionkey")
    return stats.merkle_roots(n, "n_regionkey")


@query('SELECT \'mint\' AS "index", CAST(count(DISTINCT mint) AS BIGINT) AS unique_keys, CAST(count(*) AS BIGINT) AS n_accounts FROM tok_lineitem UNION ALL SELECT \'token_owner\', count(DISTINCT token_owner), count(*) FROM tok_lineitem UNION ALL SELECT \'memcmp_64_8\', count(DISTINCT amount), count(*) FROM tok_lineitem', "tok_lineitem")
def index_stats_tokens(spark, d):
    """Totals of the token indexes and of a byte-match index at the amount."""
    f = C.token_columns()
    keys = {"mint": F.hex(f["mint"]), "token_owner": F.hex(f["token_owner"]), "memcmp_64_8": F.hex(C.bytes_at("data", 64, 8))}
    return stats.index_totals(views.tok_data(spark, d), keys)


# sets


@query("SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'F' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS there FROM customer", "upd_orders")
def set_membership(spark, d):
    """Customers in a set after an insertion; those only of orders with status F were taken out before it."""
    o, c = views.table(spark, d, "orders").where("o_totalprice > 400000"), views.table(spark, d, "customer")
    ids = sets.remove(o.select(F.col("o_custkey").alias("id")), sets.remove(o.select(F.col("o_custkey").alias("id")), o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("id"))))
    return sets.contains(sets.insert(ids, c.where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))), c.select(F.col("c_custkey").alias("id")))


@query("SELECT l_orderkey, array_to_string(list(v ORDER BY v), ',') AS merged FROM (SELECT DISTINCT l_orderkey, v, rn FROM (SELECT l_orderkey, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber) AS rn FROM lineitem WHERE l_returnflag IN ('A', 'R'))) GROUP BY 1")
def merged_lists(spark, d):
    """Line numbers of an order's returned and accepted lines, merged."""
    t = views.table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')")
    lines = lambda flag: F.array_sort(F.filter(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber"))), lambda x: x.isNotNull()))
    both = t.groupBy("l_orderkey").agg(lines("A").alias("a"), lines("R").alias("r"))
    return both.select("l_orderkey", F.array_join(sets.merge_sorted(F.col("a"), F.col("r")), ",").alias("merged"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_concat(list_filter(range(0, 64), lambda b: (l_partkey >> b) & 1 = 1), list_transform(list_filter(range(0, 64), lambda b: (l_suppkey >> b) & 1 = 1), lambda b: b + 64)), ',') AS places FROM lineitem")
def set_bits(spark, d):
    words = F.array("l_partkey", "l_suppkey")
    return views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(sets.all_set(words), ",").alias("places"))


@query("SELECT CAST(min(l_suppkey) + 1 AS BIGINT) AS id FROM lineitem WHERE l_suppkey > 5")
def bitmap_first(spark, d):
    """The least supplier above 5 in a bitmap."""
    return sets.bitmap_first(sets.to_bitmaps(views.table(spark, d, "lineitem").where("l_suppkey > 5").select((F.col("l_suppkey") + 1).alias("id"))))


@query("SELECT CAST(count(DISTINCT CASE WHEN id = 0 THEN 0 ELSE (id - 1) // 32768 + 1 END) AS BIGINT) AS buckets, CAST(4096 * count(DISTINCT CASE WHEN id = 0 THEN 0 ELSE (id - 1) // 32768 + 1 END) AS BIGINT) AS bytes FROM (SELECT l_suppkey + 1 AS id FROM lineitem)")
def bitmap_bytes(spark, d):
    return sets.bitmap_bytes(sets.to_bitmaps(views.table(spark, d, "lineitem").select((F.col("l_suppkey") + 1).alias("id"))))

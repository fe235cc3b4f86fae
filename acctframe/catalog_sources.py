"""Queries of sources, stores and streams: tables go through files, logs and micro-batches and come back the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from acctframe import cache, jobs, shared, views
from acctframe.catalog import query
from acctframe.functions import columns as C
from acctframe.operators import sets, stats, versions
from acctframe.schemas import LOCATION
from acctframe.sources import records, segments
from acctframe.streaming import ingest
from acctframe.views import key32, key_number, part_accounts, part_updates, upd_events, upd_orders

# base files

PARTS = "SELECT p_partkey AS pubkey, p_brand AS owner, p_name AS data, CAST(p_size AS BIGINT) AS slot, CAST(p_size AS BIGINT) AS lamports, p_size % 2 = 0 AS executable FROM part"


def account_files(spark, d) -> str:
    """The parts as base files; the folder is written anew for each query, by the data source."""
    spark.dataSource.register(records.AccountsSource)
    path = shared.new_path(spark, "account-files")
    part_accounts(spark, d).withColumn("location", F.lit(None).cast(LOCATION)).write.format("accounts").mode("append").save(path)
    return path


def readable(accounts):
    """pubkey and owner of the parts' accounts as number and text, data as text."""
    out = {"pubkey": key_number("pubkey"), "owner": F.rtrim(F.decode("owner", "UTF-8")), "data": F.decode("data", "UTF-8"), "lamports": F.col("lamports").cast("long")}
    return accounts.withColumns({k: v for k, v in out.items() if k in accounts.columns})


SHOWN = ["pubkey", "owner", "data", "slot", "lamports", "executable"]


@query(PARTS)
def account_files_source(spark, d):
    """The data source, which finds files by number and walks their records."""
    return readable(spark.read.format("accounts").load(account_files(spark, d))).select(SHOWN)


@query(PARTS)
def account_files_scan(spark, d):
    """The scan through Spark's binary reader."""
    return readable(records.scan(spark, account_files(spark, d))).select(SHOWN)


@query("SELECT p_partkey AS pubkey, CAST(strlen(p_name) AS BIGINT) AS data_len, CAST(strlen(p_name) + 97 AS BIGINT) AS stored_size, CAST(p_size AS BIGINT) AS slot FROM part")
def account_fields(spark, d):
    return records.scan(spark, account_files(spark, d), columns=["pubkey", "data_len", "stored_size", "slot"]).withColumn("pubkey", key_number("pubkey"))


@query("SELECT CAST(count(*) AS BIGINT) AS accounts, CAST(sum(strlen(p_name) + 97) AS BIGINT) AS bytes, round(avg(strlen(p_name)), 9) AS mean_data_len FROM part")
def account_file_stats(spark, d):
    return records.scan_stats(records.scan(spark, account_files(spark, d))).select("accounts", "bytes", F.round("mean_data_len", 9).alias("mean_data_len"))


@query("SELECT p_partkey AS pos, p_name AS data, CAST(NULL AS VARCHAR) AS error FROM part UNION ALL SELECT -1, NULL, 'unknown file' UNION ALL SELECT -2, NULL, 'no record'")
def read_batch(spark, d):
    """Every record by its place, a place in a file that is not there, and one that holds no record."""
    path = account_files(spark, d)
    places = records.scan(spark, path, columns=["pubkey", "file_id", "offset"]).select(key_number("pubkey").alias("pos"), "file_id", "offset")
    bad = places.agg(F.min("file_id").alias("file_id")).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(1 << 40).cast("long").alias("file_id"), F.lit(0).cast("long").alias("offset")), F.struct(F.lit(-2).cast("long").alias("pos"), "file_id", F.lit(1 << 40).cast("long").alias("offset")))).alias("x")).select("x.*")
    return records.read_batch(spark, path, places.unionByName(bad)).select("pos", F.decode("data", "UTF-8").alias("data"), "error")


@query(f"SELECT * FROM ({PARTS}) WHERE pubkey = 11")
def locate_key(spark, d):
    return readable(records.locate(records.scan(spark, account_files(spark, d)), b"%032d" % 11)).select(SHOWN)


@query(f"SELECT pubkey, owner, data, slot, lamports, executable FROM ({PARTS})")
def job_bootstrap(spark, d):
    """The bootstrap job from base files to a Parquet base."""
    base = shared.new_path(spark, "base")
    jobs.main(["bootstrap", account_files(spark, d), base, "--partitions", "4"], spark)
    return readable(spark.read.parquet(base)).select(SHOWN)


# locator and dictionary


@query("SELECT p_partkey AS pubkey, CAST(CASE WHEN p_brand = 'Brand#4' THEN 2 ELSE 1 END AS BIGINT) AS file_id, p_partkey * 100 AS \"offset\" FROM part WHERE p_size <> 10 OR p_brand = 'Brand#4'")
def locator_table(spark, d):
    """Insertion of all parts, deletion of those of size 10, insertion of a brand's at another place, compaction in between."""
    where = lambda p, file: p.select(key32(F.col("p_partkey")).alias("pubkey"), F.struct(*[(F.lit(file) if f.name == "file_id" else F.col("p_partkey") * 100 if f.name == "offset" else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION]).alias("location"))
    parts = views.table(spark, d, "part")
    found = records.Locator(spark, shared.new_path(spark, "locator"))
    found.insert(where(parts, 1))
    found.delete(where(parts.where("p_size = 10"), 1))
    found.compact(4)
    found.insert(where(parts.where("p_brand = 'Brand#4'"), 2))
    return found.table().select(key_number("pubkey").alias("pubkey"), "location.file_id", "location.offset")


@query("SELECT CAST(pos AS BIGINT) AS pos, p_partkey * 100 AS \"offset\" FROM (VALUES (0, 7), (1, -1), (2, 3), (3, 7)) AS k(pos, key) LEFT JOIN part ON p_partkey = key")
def locator_batch(spark, d):
    found = records.Locator(spark, shared.new_path(spark, "locator"))
    place = F.struct(*[(F.col("p_partkey") * 100 if f.name == "offset" else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOCATION])
    found.insert(views.table(spark, d, "part").select(key32(F.col("p_partkey")).alias("pubkey"), place.alias("location")))
    return found.get_batch([b"%032d" % k if k >= 0 else b"-" * 32 for k in (7, -1, 3, 7)]).select("pos", "location.offset")


@query("WITH a AS (SELECT source, min(doc_id) AS seen FROM documents WHERE n_chars < 1000 GROUP BY 1), x AS (SELECT source, row_number() OVER (ORDER BY seen, source) AS id FROM a), b AS (SELECT source, min(doc_id) AS seen FROM documents WHERE source NOT IN (SELECT source FROM a) GROUP BY 1) SELECT source AS owner, CAST(id AS BIGINT) AS id FROM x UNION ALL SELECT source, CAST((SELECT count(*) FROM x) + row_number() OVER (ORDER BY seen, source) AS BIGINT) FROM b")
def persistent_dictionary(spark, d):
    """Sources get ids from the shorter documents, then from all: the first ids stay."""
    docs = views.blob_docs(spark, d)
    known = sets.PersistentDictionary(spark, shared.new_path(spark, "dictionary-table"), "owner", "string")
    known.grow(docs.where("lamports < 1000").select("owner", "pubkey"), "pubkey")
    known.grow(docs.select("owner", "pubkey"), "pubkey")
    return known.table()


@query("SELECT source AS owner FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'es'")
def decoded_ids(spark, d):
    """Bitmaps of the sources of two languages, their intersection, and the keys of the ids that are left."""
    known = shared.stored(sets.dictionary(views.blob_docs(spark, d), "owner", "pubkey"), "ids")
    docs = views.table(spark, d, "documents").select("lang", F.col("source").alias("owner")).join(known, "owner").select("lang", "id")
    both = sets.bitmap_and(sets.to_bitmaps(docs, "lang"), ["en", "es"], "lang")
    return sets.decode(sets.bitmap_ids(both), known, "owner").select("owner")


@query("SELECT 'line' AS \"index\", CAST(count(DISTINCT l_linenumber) AS BIGINT) AS keys, CAST((SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber <> 3)) AS BIGINT) AS ids FROM lineitem WHERE l_linenumber <> 3")
def bitmap_store_stats(spark, d):
    """Postings of suppliers by line number are stored twice, and one key is removed."""
    store = sets.BitmapStore(spark, shared.new_path(spark, "bitmaps"))
    posts = sets.to_bitmaps(views.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") + 1).alias("id")), "line")
    for slot in (1, 2):
        store.store("line", posts, slot)
    store.remove("line", [3], 3)
    return store.stats().select("index", "keys", "ids")


@query("SELECT DISTINCT l_suppkey + 1 AS id FROM lineitem WHERE l_linenumber = 5")
def bitmap_store_get(spark, d):
    store = sets.BitmapStore(spark, shared.new_path(spark, "bitmaps"))
    store.store("line", sets.to_bitmaps(views.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") + 1).alias("id")), "line"), 1)
    return sets.bitmap_ids(store.get("line", 5))


# segments

EVENTS = "SELECT pubkey, slot, write_version, decode(data) AS data FROM upd_events"


def _segment_rows(spark, d):
    u = upd_events(spark, d)
    return u.select("slot", "write_version", key32(F.col("pubkey")).alias("pubkey"), "data")


def _segments(spark, d) -> str:
    spark.dataSource.register(segments.SegmentSource)
    path = shared.new_path(spark, "segments")
    rows = _segment_rows(spark, d)
    rows.withColumns({"segment": F.lit(None).cast("string"), "offset": F.lit(None).cast("long")}).write.format("delta_segment").mode("append").save(path)
    return path


def _event_rows(rows):
    return rows.select(key_number("pubkey").alias("pubkey"), "slot", "write_version", F.decode("data", "UTF-8").alias("data"))


@query(EVENTS, "upd_events")
def segment_files(spark, d):
    """Events through segment files, whose headers are checked as they are read."""
    return _event_rows(spark.read.format("delta_segment").load(_segments(spark, d)))


@query("SELECT CAST(count(*) AS BIGINT) AS entries, CAST(sum(octet_length(data) + 64) AS BIGINT) AS bytes, min(slot) AS first_slot, max(slot) AS last_slot, true AS rolled FROM upd_events", "upd_events")
def segment_roll(spark, d):
    """No segment has more entries than a segment may have."""
    c = segments.catalog(spark.read.format("delta_segment").load(_segments(spark, d)))
    return c.agg(F.sum("entry_count").alias("entries"), F.sum("data_size").cast("long").alias("bytes"), F.min("start_slot").alias("first_slot"), F.max("end_slot").alias("last_slot"), (F.max("entry_count") <= segments.ROLL_ENTRIES).alias("rolled"))


@query(EVENTS, "upd_events")
def segment_stream(spark, d):
    """Events through a stream into segments, and from these through a stream into a table."""
    spark.dataSource.register(segments.SegmentSource)
    root = shared.new_path(spark, "segment-stream")
    raw = spark.readStream.schema(views.table(spark, d, "events").schema).format("parquet").load(f"{d}/events.parquet*")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    rows = raw.select(hour.alias("slot"), F.col("event_id").alias("write_version"), key32(F.col("user_id")).alias("pubkey"), F.encode("props", "UTF-8").alias("data"), F.lit(None).cast("string").alias("segment"), F.lit(None).cast("long").alias("offset"))
    rows.writeStream.format("delta_segment").option("path", f"{root}/segments").option("checkpointLocation", f"{root}/written").trigger(availableNow=True).start().awaitTermination()
    ingest.drain(spark.readStream.format("delta_segment").load(f"{root}/segments"), f"{root}/read", "append")
    return _event_rows(spark.read.parquet(f"{root}/read"))


@query("SELECT pubkey, slot, write_version FROM upd_orders WHERE slot <= 300 AND slot // 100 NOT IN (SELECT slot // 100 FROM upd_orders GROUP BY 1 HAVING max(slot) <= 100)", "upd_orders")
def dropped_segments(spark, d):
    """The delta without the segments that end at or before slot 100, up to slot 300."""
    delta = upd_orders(spark, d).withColumn("segment", F.floor(F.col("slot") / 100))
    old = segments.catalog(delta.withColumn("data", F.lit(bytearray(b"")).cast("binary"))).where("end_slot <= 100").select("segment")
    return versions.visible(segments.without_segments(delta, old), 300).select("pubkey", "slot", "write_version")


# ingestion, state and compaction

STATE = "SELECT pubkey, slot, write_version, lamports FROM (SELECT * FROM base_cust UNION ALL SELECT * FROM upd_orders) QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) = 1"


@query(STATE, "base_cust", "upd_orders")
def ingest_after_compaction(spark, d):
    """Orders up to slot 200 are ingested and compacted into the base, the others are ingested after that; then both layers are read."""
    root = shared.new_path(spark, "layers")
    u = upd_orders(spark, d)
    views.base_cust(spark, d).write.parquet(f"{root}/base0")
    ingest.append_updates(u.where("slot <= 200"), f"{root}/delta0", batch_id=0)
    ingest.compact_to(spark, f"{root}/base0", f"{root}/delta0", f"{root}/base1", f"{root}/delta1", 150, 4)
    ingest.append_updates(u.where("slot > 200"), f"{root}/delta1", batch_id=1)
    return versions.merge_delta(spark.read.parquet(f"{root}/base1"), ingest.read_delta(spark, f"{root}/delta1").drop(*ingest.LAYOUT)).select("pubkey", "slot", "write_version", "lamports")


@query("SELECT pubkey, slot FROM (SELECT * FROM upd_orders QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) = 1) WHERE slot BETWEEN 1000 AND 1500", "upd_orders")
def bucketed_slot_range(spark, d):
    """A range of slots of a delta table by slot buckets."""
    path = f"{shared.new_path(spark, 'delta')}"
    ingest.append_updates(upd_orders(spark, d), path)
    return versions.slot_range(ingest.read_delta(spark, path), 1000, 1500).select("pubkey", "slot")


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS n_updates FROM events GROUP BY 1")
def running_cardinality(spark, d):
    out = shared.new_path(spark, "running")
    ingest.drain(ingest.running_cardinality(spark.readStream.schema(views.table(spark, d, "events").schema).format("parquet").load(f"{d}/events.parquet*"), "event_type"), out)
    return spark.read.parquet(out)


@query("SELECT user_id AS pubkey, event_id AS write_version, event_type AS owner FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 3600) DESC, event_id DESC) = 1")
def running_latest(spark, d):
    raw = spark.readStream.schema(views.table(spark, d, "events").schema).format("parquet").load(f"{d}/events.parquet*")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    out = shared.new_path(spark, "running")
    ingest.drain(ingest.latest_stream(raw.select(F.col("user_id").alias("pubkey"), hour.alias("slot"), F.col("event_id").alias("write_version"), F.col("event_type").alias("owner"))), out)
    return spark.read.parquet(out).select("pubkey", "write_version", "owner")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_s, event_type, CAST(count(*) AS BIGINT) AS n_updates FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Six-hour windows of event time over the table as a stream."""
    raw = spark.readStream.schema(views.table(spark, d, "events").schema).format("parquet").load(f"{d}/events.parquet*")
    out = shared.new_path(spark, "windows")
    ingest.drain(ingest.windowed(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "6 hours", "event_type"), out)
    return spark.read.parquet(out).select(F.unix_seconds("start").alias("start_s"), "event_type", "n_updates")


@query("SELECT m AS processed, m - 1 AS confirmed, m - 50 AS finalized, CAST(0 AS BIGINT) AS parent, m - 50 AS root FROM (SELECT max(slot) AS m FROM upd_orders)", "upd_orders")
def commitment_state(spark, d):
    """The state after the newest slot, whose root is then rolled back."""
    state = ingest.CommitmentState()
    newest = segments.latest_slot(upd_orders(spark, d)).first()[0]
    state.observe(newest)
    assert not state.update("processed", newest - 5)  # watermarks only rise
    state.roll_back(newest - 50)
    return ingest.state_table(ingest.CommitmentState.load(state.dump()), spark)


@query("SELECT count(DISTINCT slot // 100) >= 10 OR count(*) >= 100000 OR max(slot) - min(slot) >= 100000 AS due, CAST(count(DISTINCT slot // 100) AS BIGINT) AS segments FROM upd_orders", "upd_orders")
def compaction_policy(spark, d):
    u = upd_orders(spark, d)
    row = u.agg(F.count_distinct(F.floor(F.col("slot") / 100)), F.count("*"), F.max("slot") - F.min("slot")).first()
    return spark.range(1, numPartitions=1).select(F.lit(ingest.compaction_due(*row)).alias("due"), F.lit(row[0]).cast("long").alias("segments"))


LOG = "SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus <> 'F' AS kept FROM orders UNION ALL SELECT c_custkey, -1, true FROM customer WHERE c_acctbal > 0"


def _log(spark, d):
    o = views.table(spark, d, "orders")
    entries = [sets.log_entries(o.where(f"(o_orderstatus <> 'F') = {k}").select(F.col("o_custkey").alias("id"), "o_orderkey").select("id", F.col("o_orderkey").alias("s")), F.col("s"), k) for k in (True, False)]
    return views.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), entries[0].unionByName(entries[1])


@query(f"SELECT id FROM ({LOG}) GROUP BY id HAVING arg_max(kept, seq)")
def lsm_layers(spark, d):
    """Customers under a log of insertions and removals; the newest entry of each counts."""
    return sets.layered(*_log(spark, d))


@query(f"SELECT id FROM ({LOG}) GROUP BY id HAVING arg_max(kept, seq)")
def lsm_compaction(spark, d):
    base, log = _log(spark, d)
    return sets.layered(*sets.compact_log(base, log, 5000))


# results and tiers


@query("SELECT 'orders' AS query, CAST(300 AS BIGINT) AS slot, CAST(count(*) AS BIGINT) AS n_rows FROM upd_orders WHERE slot <= 300", "upd_orders")
def result_heads(spark, d):
    """A stored result's slot and count; another one is removed with its files."""
    store = cache.ResultStore(spark, shared.new_path(spark, "results"))
    rows = versions.visible(upd_orders(spark, d), 300).select("pubkey", "slot")
    store.put("orders", rows, 300)
    store.put("outdated", rows, 0)
    assert store.cleanup(300) == ["outdated"]
    return store.heads().select("query", "slot", "n_rows")


@query("SELECT DISTINCT c_mktsegment AS query FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 2)")
def result_invalidation(spark, d):
    """Results of customers by segment, and which of them the customers of two orders drop."""
    store = cache.ResultStore(spark, shared.new_path(spark, "results"), strategy="batch")
    c = views.table(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").alias("pubkey"))
    for (segment,) in c.select("c_mktsegment").distinct().collect():  # 5 rows
        store.put(segment, c.where(F.col("c_mktsegment") == segment), 0)
    store.changed(views.table(spark, d, "orders").where("o_orderkey < 2").select(F.col("o_custkey").alias("pubkey")))
    gone = store.flush()
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(q) for q in gone])).alias("query"))


@query("SELECT * FROM (WITH a AS (SELECT pubkey, max(slot) AS last FROM (SELECT pubkey, slot FROM base_cust UNION ALL SELECT pubkey, slot FROM upd_orders) GROUP BY 1), b AS (SELECT pubkey, CASE WHEN pubkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 20000 WHEN pubkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') THEN least(last, 10000) ELSE last END AS last FROM a) SELECT CASE WHEN 20000 - last < 100 THEN 'hot' WHEN 20000 - last < 10000 THEN 'warm' ELSE 'cold' END AS tier, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1)", "base_cust", "upd_orders")
def tier_moves(spark, d):
    """Customers' tiers after their orders' accesses, one segment's promotion and another's demotion to cold."""
    c = views.base_cust(spark, d)
    entries = stats.touch(c.select("pubkey", F.col("slot").alias("last_access")), upd_orders(spark, d).select("pubkey", "slot"))
    entries = stats.demote(entries, c.where("owner = 'MACHINERY'"), 20_000, "cold")
    entries = stats.promote(entries, c.where("owner = 'BUILDING'"), 20_000)
    return entries.groupBy(C.tier(F.col("last_access"), F.lit(20_000)).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT pubkey, slot, write_version, lamports FROM (SELECT p_partkey AS pubkey, CAST(1000 AS BIGINT) AS slot, CAST(2 AS BIGINT) AS write_version, CAST(p_size + 1000 AS BIGINT) AS lamports FROM part WHERE p_size > 40)")
def update_records(spark, d):
    """Updates as they arrive, reduced to the newest and turned into plain accounts and back."""
    from acctframe.operators import predicates as P

    arrived = part_updates(spark, d).drop("storage_type").withColumns({"tx_index": F.lit(0).cast("long"), "is_startup": F.lit(False)})
    newest = versions.latest(P.from_updates(arrived))
    again = P.from_plain(P.to_plain(newest), F.lit(1000), F.lit(2))
    return again.select(key_number("pubkey").alias("pubkey"), "slot", "write_version", F.col("lamports").cast("long").alias("lamports"))

"""Registry of the engine's queries and their SQL: one entry per operator, over views with account semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe import cache, shared, views
from acctframe.functions import codecs
from acctframe.functions import columns as C
from acctframe.operators import predicates as P
from acctframe.operators import sets, stats, versions
from acctframe.plans import paging, planner
from acctframe.views import base_cust, blob_docs, blob_parts, deps_conv, tok_lineitem, upd_events, upd_orders

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

BRAND, PREFIX, NAME_BYTES = "Brand#4", b"re", 9
DOC_OWNER, DOC_PREFIX = "src3", b"Th"
CUTOFF, ROOT = 300, 200
HOUR = 473_500


def query(sql: str | None, *names: str):
    """Registers a query; its SQL may use the views named."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = ("WITH " + ", ".join(f"{n} AS ({views.SQL[n]})" for n in names) + " " if names else "") + sql
        return f

    return register


def _whole() -> None:
    """The other modules of the catalog register their queries as they are imported."""
    from acctframe import catalog_engine, catalog_sources  # noqa: F401


def queries() -> dict[str, Query]:
    _whole()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _whole()
    return dict(_SQL)


# filters

SHOW = "pubkey, owner, data_len, lower(hex(data)) AS data_hex"


def show(df: DataFrame) -> DataFrame:
    return df.select("pubkey", "owner", "data_len", F.lower(F.hex("data")).alias("data_hex"))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}'", "blob_parts")
def gpa_program(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}' AND data_len = {NAME_BYTES}", "blob_parts")
def gpa_data_size(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.DataSize(NAME_BYTES)]))


@query(f"SELECT pubkey, data_len FROM blob_docs WHERE owner = '{DOC_OWNER}' AND data[1:2] = encode('Th')", "blob_docs")
def gpa_memcmp(spark, d):
    return P.program_accounts(blob_docs(spark, d), DOC_OWNER, [P.Memcmp(0, DOC_PREFIX)]).select("pubkey", "data_len")


@query("SELECT pubkey, owner FROM blob_parts WHERE data_len >= 8 AND data[1:8] = encode('red widg')", "blob_parts")
def gpa_discriminator(spark, d):
    a = P.with_index_columns(blob_parts(spark, d))
    return a.where(P.Discriminator(b"red widg").column(set(a.columns))).select("pubkey", "owner")


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}' AND data_len = 10 AND data[1:2] = encode('re') AND data[1:8] = encode('red widg')", "blob_parts")
def gpa_all_filters(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.DataSize(10), P.Memcmp(0, PREFIX), P.Discriminator(b"red widg")]))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}' AND data_len = 9 AND data[1:2] = encode('re')", "blob_parts")
def gpa_size_memcmp(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.DataSize(9), P.Memcmp(0, PREFIX)]))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}' AND data_len >= 6 AND data[5:6] = encode('wi')", "blob_parts")
def gpa_memcmp_offset(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.Memcmp(4, b"wi")]))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}' AND false", "blob_parts")
def gpa_absent_key(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.DataSize(10_000)]))


@query(f"SELECT {SHOW} FROM blob_parts WHERE owner = '{BRAND}'", "blob_parts")
def gpa_skip_mode(spark, d):
    return show(P.program_accounts(blob_parts(spark, d), BRAND, [P.DataSize(10_000)], missing_index="skip"))


@query('SELECT owner, "offset", length, lower(hex(bytes)) AS bytes_hex, CAST(count(*) AS BIGINT) AS n FROM (SELECT owner, CAST(0 AS BIGINT) AS "offset", CAST(8 AS BIGINT) AS length, data[1:8] AS bytes FROM blob_parts WHERE data_len >= 8 UNION ALL SELECT owner, 1, 4, data[2:5] FROM blob_parts WHERE data_len >= 5) GROUP BY ALL', "blob_parts")
def accelerated_memcmp(spark, d):
    t = P.tracked_offsets(blob_parts(spark, d), [(0, 8), (1, 4), (3, 0)])
    return t.groupBy("owner", "offset", "length", F.lower(F.hex("bytes")).alias("bytes_hex")).agg(F.count("*").alias("n"))


# sorting and pages


@query("SELECT pubkey, lamports FROM blob_parts ORDER BY lamports, pubkey", "blob_parts")
def sort_lamports(spark, d):
    return paging.sort_accounts(blob_parts(spark, d), "lamports").select("pubkey", "lamports")


@query("SELECT pubkey, data_len FROM blob_docs ORDER BY data_len, pubkey", "blob_docs")
def sort_data_size(spark, d):
    return paging.sort_accounts(blob_docs(spark, d), "data_size").select("pubkey", "data_len")


@query("SELECT pubkey, slot FROM blob_parts ORDER BY slot DESC, pubkey", "blob_parts")
def sort_slot_desc(spark, d):
    return paging.sort_accounts(blob_parts(spark, d), "slot_desc").select("pubkey", "slot")


@query("SELECT pubkey, data_len FROM blob_docs WHERE owner = 'src3' ORDER BY pubkey LIMIT 10 OFFSET 10", "blob_docs")
def gpa_page_n(spark, d):
    rows = P.program_accounts(blob_docs(spark, d), DOC_OWNER)
    first = paging.page(rows, 10)
    return spark.createDataFrame([(r.pubkey, r.data_len) for r in paging.page(rows, 10, first.next_cursor).rows], "pubkey long, data_len long")


@query("SELECT pubkey, data_len FROM blob_docs WHERE owner = 'src3' ORDER BY pubkey LIMIT 7 OFFSET 5", "blob_docs")
def gpa_offset_page(spark, d):
    return paging.offset_page(P.program_accounts(blob_docs(spark, d), DOC_OWNER), 5, 7).select("pubkey", "data_len")


@query("SELECT pubkey FROM blob_parts ORDER BY pubkey LIMIT 25", "blob_parts")
def first_ids(spark, d):
    return sets.first_n(blob_parts(spark, d).select("pubkey"), 25)


# point reads


@query("SELECT pubkey, data_len FROM blob_docs WHERE pubkey = 42", "blob_docs")
def account_info(spark, d):
    return P.account(blob_docs(spark, d), 42).select("pubkey", "data_len")


@query("SELECT CAST(pos AS BIGINT) AS pos, key, b.owner, b.data_len FROM (VALUES (0, 5), (1, -1), (2, 7), (3, 5)) AS k(pos, key) LEFT JOIN blob_docs b ON b.pubkey = key", "blob_docs")
def multi_accounts(spark, d):
    return P.multiple_accounts(spark, blob_docs(spark, d), [5, -1, 7, 5]).select("pos", F.col("key").cast("int").alias("key"), "owner", "data_len")


@query("SELECT owner, data_len, lower(hex(data[1:8])) AS discriminator FROM blob_docs WHERE pubkey = 11", "blob_docs")
def reverse_lookup(spark, d):
    a = P.account(P.with_index_columns(blob_docs(spark, d)), 11)
    return a.select("owner", "data_len", F.lower(F.hex("discriminator")).alias("discriminator"))


@query("SELECT DISTINCT owner AS key FROM blob_docs", "blob_docs")
def distinct_programs(spark, d):
    return P.keys_of(blob_docs(spark, d), "owner")


@query("SELECT DISTINCT data_len AS key FROM blob_parts", "blob_parts")
def distinct_sizes(spark, d):
    return P.keys_of(blob_parts(spark, d), "data_len")


@query("SELECT DISTINCT lower(hex(data[1:8])) AS key FROM blob_parts WHERE data_len >= 8", "blob_parts")
def distinct_discriminators(spark, d):
    return P.keys_of(blob_parts(spark, d), F.lower(F.hex(C.discriminator())))


@query("SELECT pubkey, slot FROM blob_parts WHERE slot BETWEEN 10 AND 20", "blob_parts")
def range_lookup(spark, d):
    return blob_parts(spark, d).where(F.col("slot").between(10, 20)).select("pubkey", "slot")


@query("SELECT DISTINCT pubkey FROM blob_parts WHERE slot = 15", "blob_parts")
def numeric_lookup(spark, d):
    return blob_parts(spark, d).where("slot = 15").select("pubkey").distinct()


# tokens


@query("SELECT pubkey, line, mint, CAST(amount AS DECIMAL(20,0)) AS amount FROM tok_lineitem WHERE token_owner = 3", "tok_lineitem")
def tokens_by_owner(spark, d):
    t = views.tok_data(spark, d)
    mine = t.where(P.TokenField("token_owner", b"%032d" % 3, "token").column(set(t.columns)))
    return mine.select("pubkey", "line", views.key_number(C.token_columns()["mint"]).alias("mint"), C.token_columns()["amount"].alias("amount"))


@query("SELECT pubkey, line, token_owner, CAST(amount AS DECIMAL(20,0)) AS amount FROM tok_lineitem WHERE mint = 7", "tok_lineitem")
def tokens_by_mint(spark, d):
    t = views.tok_data(spark, d)
    mine = t.where(P.TokenField("mint", b"%032d" % 7, "token").column(set(t.columns)))
    return mine.select("pubkey", "line", views.key_number(C.token_columns()["token_owner"]).alias("token_owner"), C.token_columns()["amount"].alias("amount"))


@query("SELECT pubkey, line, mint, token_owner, CAST(amount AS DECIMAL(20,0)) AS amount FROM tok_lineitem", "tok_lineitem")
def token_fields(spark, d):
    f = C.token_columns()
    return views.tok_data(spark, d).select("pubkey", "line", views.key_number(f["mint"]).alias("mint"), views.key_number(f["token_owner"]).alias("token_owner"), f["amount"].alias("amount"))


@query("SELECT token_owner AS pubkey, mint, amount FROM (SELECT token_owner, mint, CAST(sum(amount) AS DOUBLE) AS amount FROM tok_lineitem GROUP BY ALL) WHERE mint = 7 ORDER BY amount DESC, token_owner LIMIT 20", "tok_lineitem")
def token_largest(spark, d):
    held = tok_lineitem(spark, d).groupBy(F.col("token_owner").alias("pubkey"), "mint").agg(F.sum("amount").alias("amount"))
    return stats.largest_token_accounts(held, 7)


@query("SELECT p_partkey AS pubkey, lower(hex(encode(p_name)[1:4])) AS mint_hex, CAST(ascii(p_name[5:5]) + 256 * ascii(p_name[6:6]) AS DECIMAL(20,0)) AS amount FROM part WHERE strlen(p_name) >= 6")
def token_layout(spark, d):
    a = blob_parts(spark, d)
    return a.select("pubkey", F.lower(F.hex(C.bytes_at("data", 0, 4))).alias("mint_hex"), C.le_uint("data", 4, 2).alias("amount")).where("amount is not null")


# versions


@query("SELECT pubkey, slot, write_version, owner, lamports FROM upd_events QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) = 1", "upd_events")
def latest_version(spark, d):
    return versions.latest(upd_events(spark, d)).select("pubkey", "slot", "write_version", "owner", "lamports")


@query("SELECT pubkey, slot, write_version, CAST(row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) AS INT) AS rank FROM upd_events QUALIFY rank <= 3", "upd_events")
def version_history(spark, d):
    return versions.history(upd_events(spark, d), 3).select("pubkey", "slot", "write_version", "rank")


STATE = "SELECT pubkey, slot, write_version, lamports, storage_type FROM (SELECT * FROM base_cust UNION ALL SELECT * FROM upd_orders) WHERE slot <= {} QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC, storage_type = 'delta' DESC) = 1"
STATE_COLUMNS = ["pubkey", "slot", "write_version", "lamports", "storage_type"]


@query(STATE.format(CUTOFF), "base_cust", "upd_orders")
def delta_over_base(spark, d):
    return versions.merge_delta(base_cust(spark, d), versions.visible(upd_orders(spark, d), CUTOFF)).select(STATE_COLUMNS)


@query(STATE.format(CUTOFF - 1), "base_cust", "upd_orders")
def visible_confirmed(spark, d):
    return versions.accounts_at([base_cust(spark, d), upd_orders(spark, d)], CUTOFF - 1).select(STATE_COLUMNS)


@query(STATE.format(CUTOFF - 31), "base_cust", "upd_orders")
def latest_at_finalized(spark, d):
    return versions.accounts_at([base_cust(spark, d), upd_orders(spark, d)], CUTOFF - 31).select(STATE_COLUMNS)


@query("SELECT pubkey, slot FROM upd_orders WHERE slot BETWEEN 100 AND 150", "upd_orders")
def slot_range(spark, d):
    return versions.slot_range(upd_orders(spark, d), 100, 150).select("pubkey", "slot")


@query("SELECT pubkey, slot, write_version FROM upd_orders WHERE slot <= 200 OR write_version > 1000", "upd_orders")
def rollback_view(spark, d):
    return versions.roll_back(upd_orders(spark, d), ROOT, "write_version", 1000).select("pubkey", "slot", "write_version")


@query(STATE.format(ROOT).replace("storage_type FROM (", "'compacted' AS storage_type FROM ("), "base_cust", "upd_orders")
def compaction_result(spark, d):
    return versions.compact(base_cust(spark, d), upd_orders(spark, d), ROOT)[0].select(STATE_COLUMNS)


@query("SELECT CAST(count(*) AS BIGINT) AS n_left, CAST(min(slot) AS BIGINT) AS first_slot FROM upd_orders WHERE slot > 200", "upd_orders")
def compaction_rest(spark, d):
    return versions.compact(base_cust(spark, d), upd_orders(spark, d), ROOT)[1].agg(F.count("*").alias("n_left"), F.min("slot").alias("first_slot"))


@query("SELECT pubkey, slot > 473500 OR (slot = 473500 AND write_version >= 500) AS at_least, slot > 473500 OR (slot = 473500 AND write_version > 500) AS newer, write_version FROM upd_events", "upd_events")
def freshness(spark, d):
    s, w = F.col("slot"), F.col("write_version")
    at = F.lit(HOUR), F.lit(500)
    return upd_events(spark, d).select("pubkey", C.is_at_least(s, w, *at).alias("at_least"), C.is_newer(s, w, *at).alias("newer"), "write_version")


@query("SELECT pubkey, slot <= 269 AS is_finalized, slot <= 299 AS is_confirmed, write_version FROM upd_orders", "upd_orders")
def commitment_flags(spark, d):
    at = C.lagged_slots(F.lit(CUTOFF))
    return upd_orders(spark, d).select("pubkey", (F.col("slot") <= at["finalized"]).alias("is_finalized"), (F.col("slot") <= at["confirmed"]).alias("is_confirmed"), "write_version")


@query("SELECT slot AS processed, CASE WHEN slot > 1 THEN slot - 1 ELSE 0 END AS confirmed, CASE WHEN slot > 31 THEN slot - 31 ELSE 0 END AS finalized FROM (SELECT DISTINCT slot FROM upd_orders)", "upd_orders")
def slot_context(spark, d):
    s = upd_orders(spark, d).select("slot").distinct()
    return s.select(*[v.cast("long").alias(k) for k, v in C.lagged_slots(F.col("slot")).items()])


@query("SELECT pubkey, owner, slot, write_version, lamports FROM (SELECT * FROM upd_events QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) = 1) WHERE owner <> 'error'", "upd_events")
def tombstones(spark, d):
    newest = versions.latest(upd_events(spark, d)).withColumn("closed", F.when(F.col("owner") == "error", 0).otherwise(1))
    return versions.without_tombstones(newest, "closed").select("pubkey", "owner", "slot", "write_version", "lamports")


@query("SELECT pubkey, owner, slot, write_version, lamports, CAST(strlen(decode(data)) AS BIGINT) AS data_len FROM upd_events", "upd_events")
def metadata_projection(spark, d):
    return P.metadata(upd_events(spark, d)).select("pubkey", "owner", "slot", "write_version", "lamports", "data_len")


# statistics


@query("SELECT owner AS key, CAST(count(*) AS BIGINT) AS n_accounts FROM blob_docs GROUP BY 1", "blob_docs")
def index_card_program(spark, d):
    return stats.cardinality(blob_docs(spark, d), "owner")


@query("SELECT data_len AS key, CAST(count(*) AS BIGINT) AS n_accounts FROM blob_parts GROUP BY 1", "blob_parts")
def index_card_size(spark, d):
    return stats.cardinality(blob_parts(spark, d), "data_len")


@query("SELECT lower(hex(data[1:8])) AS key, CAST(count(*) AS BIGINT) AS n_accounts FROM blob_parts WHERE data_len >= 8 GROUP BY 1", "blob_parts")
def index_card_disc(spark, d):
    return stats.cardinality(blob_parts(spark, d), F.lower(F.hex(C.discriminator())))


@query('SELECT \'program\' AS "index", CAST(count(DISTINCT owner) AS BIGINT) AS unique_keys, CAST(count(owner) AS BIGINT) AS n_accounts FROM blob_parts UNION ALL SELECT \'data_size\', count(DISTINCT data_len), count(data_len) FROM blob_parts UNION ALL SELECT \'discriminator\', count(DISTINCT data[1:8]), count(*) FROM blob_parts WHERE data_len >= 8', "blob_parts")
def index_stats(spark, d):
    return stats.index_totals(blob_parts(spark, d), {"program": F.col("owner"), "data_size": F.col("data_len"), "discriminator": F.hex(C.discriminator())})


@query("SELECT CAST(count(*) AS BIGINT) AS accounts, CAST(sum(data_len) AS BIGINT) AS bytes, avg(CAST(data_len AS DOUBLE)) AS mean_data_len, CAST(max(data_len) AS BIGINT) AS max_data_len FROM blob_docs", "blob_docs")
def scan_stats(spark, d):
    return blob_docs(spark, d).agg(F.count("*").alias("accounts"), F.sum("data_len").alias("bytes"), F.avg("data_len").alias("mean_data_len"), F.max("data_len").alias("max_data_len"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_updates, CAST(count(DISTINCT pubkey) AS BIGINT) AS n_kept, CAST(count(*) - count(DISTINCT pubkey) AS BIGINT) AS n_dropped FROM upd_events", "upd_events")
def dedup_stats(spark, d):
    return stats.reducer_stats(upd_events(spark, d))


TIERS = "SELECT pubkey, owner, 473700 - slot AS age FROM upd_events QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) = 1"
NOW = 473_700


@query(f"SELECT pubkey, CASE WHEN age < 100 THEN 'hot' WHEN age < 10000 THEN 'warm' ELSE 'cold' END AS tier FROM ({TIERS})", "upd_events")
def tiering(spark, d):
    return versions.latest(upd_events(spark, d)).select("pubkey", C.tier(F.col("slot"), F.lit(NOW)).alias("tier"))


@query(f"SELECT owner, CAST(count(*) FILTER (age < 100) AS BIGINT) AS n_hot, CAST(count(*) FILTER (age >= 100 AND age < 10000) AS BIGINT) AS n_warm, CAST(count(*) FILTER (age >= 10000) AS BIGINT) AS n_cold, CAST(count(*) AS BIGINT) AS n_all, round(count(*) FILTER (age < 100) * 100.0 / count(*), 6) AS hot_percent FROM ({TIERS}) GROUP BY ROLLUP (owner)", "upd_events")
def tier_rollup(spark, d):
    out = stats.tier_counts(versions.latest(upd_events(spark, d)), F.col("slot"), F.lit(NOW))
    return out.withColumn("hot_percent", F.round(F.col("hot_percent").cast("double"), 6))


@query("SELECT slot // 10 AS segment, CAST(count(*) AS BIGINT) AS entry_count, CAST(sum(octet_length(data) + 64) AS BIGINT) AS data_size, min(slot) AS start_slot, max(slot) AS end_slot FROM upd_events GROUP BY 1", "upd_events")
def segment_stats(spark, d):
    from acctframe.sources import segments

    return segments.catalog(upd_events(spark, d).withColumn("segment", F.floor(F.col("slot") / 10)))


@query('SELECT owner, "offset", CAST(count(DISTINCT bytes) AS BIGINT) AS unique_keys, CAST(count(*) AS BIGINT) AS entries, round(count(*) * 1.0 / count(DISTINCT bytes), 6) AS mean_entries FROM (SELECT owner, CAST(0 AS BIGINT) AS "offset", data[1:8] AS bytes FROM blob_parts WHERE data_len >= 8 UNION ALL SELECT owner, 1, data[2:5] FROM blob_parts WHERE data_len >= 5) GROUP BY ROLLUP (owner, "offset")', "blob_parts")
def memcmp_offset_stats(spark, d):
    out = stats.offset_stats(P.tracked_offsets(blob_parts(spark, d), [(0, 8), (1, 4)]))
    return out.withColumn("mean_entries", F.round(F.col("mean_entries").cast("double"), 6))


@query("SELECT CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS lookups, round(count(*) FILTER (event_type = 'view') * 1.0 / count(*), 9) AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    out = stats.hit_rate(views.table(spark, d, "events").select((F.col("event_type") == "view").alias("hit")))
    return out.withColumn("hit_rate", F.round(F.col("hit_rate").cast("double"), 9))


@query("SELECT CAST(sum(l_linenumber) // count(*) AS BIGINT) AS mean_time, quantile_disc(l_linenumber, 0.5) AS p50, quantile_disc(l_linenumber, 0.99) AS p99 FROM lineitem")
def mean_plan_time(spark, d):
    out = stats.mean_time(views.table(spark, d, "lineitem"), "l_linenumber")
    return out.select(F.col("mean_time").cast("long").alias("mean_time"), F.col("p50_p99")[0].alias("p50"), F.col("p50_p99")[1].alias("p99"))


# sets: orders with a small and with a large line item

A, B = "SELECT DISTINCT pubkey AS id FROM tok_lineitem WHERE amount < 10", "SELECT DISTINCT pubkey AS id FROM tok_lineitem WHERE amount > 40"


def _sides(spark, d):
    t = tok_lineitem(spark, d)
    return t.where("amount < 10").select(F.col("pubkey").alias("id")), t.where("amount > 40").select(F.col("pubkey").alias("id"))


@query(f"{A} INTERSECT {B}", "tok_lineitem")
def set_intersect(spark, d):
    return sets.intersect(*_sides(spark, d))


@query(f"{A} UNION {B}", "tok_lineitem")
def set_union(spark, d):
    return sets.union(*_sides(spark, d))


@query(f"{B} EXCEPT {A}", "tok_lineitem")
def set_difference(spark, d):
    a, b = _sides(spark, d)
    return sets.difference(b, a)


@query(f"({A} EXCEPT {B}) UNION ({B} EXCEPT {A})", "tok_lineitem")
def set_xor(spark, d):
    return sets.symmetric_difference(*_sides(spark, d))


@query(f"SELECT CAST((SELECT count(*) FROM ({A})) AS BIGINT) AS size_a, CAST((SELECT count(*) FROM ({B})) AS BIGINT) AS size_b, CAST(n_both AS BIGINT) AS n_both, CAST(n_any AS BIGINT) AS n_any, round(n_both * 1.0 / n_any, 9) AS jaccard FROM (SELECT (SELECT count(*) FROM ({A} INTERSECT {B})) AS n_both, (SELECT count(*) FROM ({A} UNION {B})) AS n_any)", "tok_lineitem")
def jaccard(spark, d):
    out = sets.overlap(*_sides(spark, d))
    return out.withColumn("jaccard", F.round(F.col("jaccard").cast("double"), 9))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT token_owner FROM tok_lineitem WHERE mint = 3 INTERSECT SELECT token_owner FROM tok_lineitem WHERE mint = 4)", "tok_lineitem")
def bitmap_intersection(spark, d):
    posts = sets.to_bitmaps(tok_lineitem(spark, d).select("mint", (F.col("token_owner") + 1).alias("id")), "mint")
    return sets.bitmap_size(sets.bitmap_and(posts, [3, 4], "mint"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT token_owner FROM tok_lineitem WHERE mint = 3 UNION SELECT token_owner FROM tok_lineitem WHERE mint = 4)", "tok_lineitem")
def bitmap_union(spark, d):
    posts = sets.to_bitmaps(tok_lineitem(spark, d).select("mint", (F.col("token_owner") + 1).alias("id")), "mint")
    return sets.bitmap_size(sets.bitmap_or(posts, [3, 4], "mint"))


@query("SELECT token_owner FROM tok_lineitem WHERE mint = 3 INTERSECT SELECT token_owner FROM tok_lineitem WHERE mint = 4", "tok_lineitem")
def bitmap_intersection_ids(spark, d):
    posts = sets.to_bitmaps(tok_lineitem(spark, d).select("mint", (F.col("token_owner") + 1).alias("id")), "mint")
    return sets.bitmap_ids(sets.bitmap_and(posts, [3, 4], "mint")).select((F.col("id") - 1).alias("token_owner"))


@query("SELECT token_owner FROM tok_lineitem WHERE mint = 3 UNION SELECT token_owner FROM tok_lineitem WHERE mint = 4", "tok_lineitem")
def bitmap_union_ids(spark, d):
    posts = sets.to_bitmaps(tok_lineitem(spark, d).select("mint", (F.col("token_owner") + 1).alias("id")), "mint")
    return sets.bitmap_ids(sets.bitmap_or(posts, [3, 4], "mint")).select((F.col("id") - 1).alias("token_owner"))


@query(f"({A} UNION {B}) EXCEPT SELECT pubkey FROM tok_lineitem WHERE amount = 25", "tok_lineitem")
def lsm_view(spark, d):
    a, b = _sides(spark, d)
    gone = tok_lineitem(spark, d).where("amount = 25").select(F.col("pubkey").alias("id"))
    return sets.with_deltas(a, [b], gone)


@query("SELECT owner, CAST(row_number() OVER (ORDER BY first_seen, owner) AS BIGINT) AS id FROM (SELECT source AS owner, min(doc_id) AS first_seen FROM documents GROUP BY 1)")
def dictionary_ids(spark, d):
    return sets.dictionary(blob_docs(spark, d), "owner", "pubkey")


@query("SELECT l_orderkey, l_linenumber, CAST(bit_count(l_orderkey & l_partkey) + bit_count(l_suppkey) AS BIGINT) AS n_and, CAST(bit_count(l_orderkey | l_partkey) + bit_count(l_suppkey) AS BIGINT) AS n_or, CAST(bit_count(xor(l_orderkey, l_partkey)) AS BIGINT) AS n_xor FROM lineitem")
def word_algebra(spark, d):
    t = views.table(spark, d, "lineitem")
    a, b = F.array("l_orderkey", "l_suppkey"), F.array("l_partkey", "l_suppkey")
    return t.select("l_orderkey", "l_linenumber", sets.popcount(sets.words_and(a, b)).alias("n_and"), sets.popcount(sets.words_or(a, b)).alias("n_or"), sets.popcount(sets.words_xor(a, b)).alias("n_xor"))


@query(f"SELECT pubkey FROM ({TIERS}) WHERE age < 10000", "upd_events")
def tier_union(spark, d):
    t = versions.latest(upd_events(spark, d)).withColumn("tier", C.tier(F.col("slot"), F.lit(NOW)))
    return t.where(F.col("tier").isin("hot", "warm")).select("pubkey")


# functions


@query("SELECT pubkey, sha256(data) AS sha FROM blob_docs", "blob_docs")
def hash_sha256(spark, d):
    return blob_docs(spark, d).select("pubkey", F.lower(F.hex(C.sha256("data"))).alias("sha"))


@query("SELECT pubkey, base64(data) AS b64, CASE WHEN data_len >= 8 THEN lower(hex(data[1:8])) END AS disc FROM blob_parts", "blob_parts")
def encode_base64(spark, d):
    return blob_parts(spark, d).select("pubkey", F.base64("data").alias("b64"), F.lower(F.hex(C.discriminator())).alias("disc"))


@query("SELECT pubkey, data_len, lower(hex(data)) AS data_hex FROM blob_parts", "blob_parts")
def base58_round_trip(spark, d):
    text = codecs.to_base58("data")
    return blob_parts(spark, d).select("pubkey", "data_len", F.lower(F.hex(codecs.from_base58(text))).alias("data_hex"))


@query("SELECT p_partkey * 1000 AS start, p_partkey * 1000 + 120 AS stop, p_partkey * 1000 + 20 AS data_start, p_partkey * 1000 + 120 AS data_stop, CAST((p_size + 7) // 8 * 8 AS BIGINT) AS aligned FROM part")
def place_ranges(spark, d):
    p = views.table(spark, d, "part").select((F.col("p_partkey") * 1000).alias("offset"), F.lit(120).alias("stored_size"), F.lit(20).alias("data_offset"), F.lit(100).alias("data_len"), "p_size")
    a, b = C.read_range(), C.data_range()
    return p.select(a[0].alias("start"), a[1].alias("stop"), b[0].alias("data_start"), b[1].alias("data_stop"), C.align8(F.col("p_size")).cast("long").alias("aligned"))


@query("SELECT pubkey, slot, 300 > slot + 100 AS outdated, slot % 5 = 0 OR 1000 > slot + slot % 5 AS expired FROM (SELECT DISTINCT pubkey, slot FROM upd_orders)", "upd_orders")
def staleness(spark, d):
    u = upd_orders(spark, d).select("pubkey", "slot").distinct()
    return u.select("pubkey", "slot", C.is_outdated(F.col("slot"), F.lit(CUTOFF)).alias("outdated"), C.is_expired(F.col("slot"), F.col("slot") % 5, F.lit(1000)).alias("expired"))


@query("SELECT pubkey, 'ai:' || pubkey || ':base64' AS key, '{\"pubkey\":' || pubkey || ',\"space\":' || data_len || '}' AS response FROM blob_parts", "blob_parts")
def responses(spark, d):
    return blob_parts(spark, d).select("pubkey", C.cursor_key(F.lit("ai"), F.col("pubkey").cast("string"), F.lit("base64")).alias("key"), C.to_response(pubkey=F.col("pubkey"), space=F.col("data_len")).alias("response"))


@query("SELECT CAST(ceil(count(*) * 0.1 * 0.05 * 0.01) AS BIGINT) AS cardinality, CAST(140 + ceil(count(*) * 0.1 * 0.05 * 0.01) * 11 AS DOUBLE) AS total_cost FROM blob_docs", "blob_docs")
def planner_selectivity(spark, d):
    n = blob_docs(spark, d).count()
    e = planner.estimate(n, [P.DataSize(1), P.Memcmp(0, b"a"), P.Discriminator(b"12345678")])
    return spark.createDataFrame([(e.cardinality, float(e.total_cost))], "cardinality long, total_cost double")


@query("WITH c AS (SELECT count(*) FILTER (p_brand = 'Brand#4') AS p, count(*) FILTER (strlen(p_name) = 9) AS s, count(*) FILTER (p_name LIKE 're%') AS m FROM part), r AS (SELECT unnest([{'f': 'program', 'n': p, 'k': 0}, {'f': 'data_size', 'n': s, 'k': 1}, {'f': 'memcmp', 'n': m, 'k': 2}]) AS x FROM c) SELECT CAST(row_number() OVER (ORDER BY x.n, x.k) AS BIGINT) AS pos, x.f AS filter, CAST(x.n AS BIGINT) AS n FROM r")
def planner_order(spark, d):
    filters = [P.DataSize(NAME_BYTES), P.Memcmp(0, PREFIX)]
    p = planner.plan(planner.collect_statistics(blob_parts(spark, d), [BRAND], filters), BRAND, filters)
    name = {"program": "program", P.DataSize: "data_size", P.Memcmp: "memcmp"}
    return spark.createDataFrame([(i + 1, name.get(f) if isinstance(f, str) else name[type(f)], n) for i, (f, n) in enumerate(zip(p.order, p.cardinalities, strict=True))], "pos long, filter string, n long")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT p_partkey) AS BIGINT) AS keys, CASE WHEN count(*) < 100 THEN 'none' WHEN count(DISTINCT p_partkey) > 0.8 * count(*) THEN 'btree' ELSE 'none' END AS layout FROM part")
def layout_advice(spark, d):
    return planner.advise(blob_parts(spark, d), "pubkey")


@query("SELECT DISTINCT query_id FROM deps_conv WHERE pubkey IN (SELECT DISTINCT user_id FROM events WHERE event_id < 20)", "deps_conv")
def invalidation_affected(spark, d):
    changes = upd_events(spark, d).where("write_version < 20")
    return cache.affected_queries(deps_conv(spark, d), changes)


@query("SELECT owner, sha256(unhex(string_agg(sha256(encode(lpad(CAST(pubkey AS VARCHAR), 12, '0')) || data), '' ORDER BY pubkey))) AS batch_sha256 FROM blob_parts GROUP BY 1", "blob_parts")
def batch_checksum(spark, d):
    a = blob_parts(spark, d).withColumn("pubkey", F.lpad(F.col("pubkey").cast("string"), 12, "0").cast("binary"))
    return stats.ordered_hash(a, "owner")


@query("SELECT event_type AS owner, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 3600) DESC, event_id DESC) = 1) GROUP BY 1")
def streaming_latest(spark, d):
    """The ingest loop over the table as a stream, then program counts over the latest rows of what it wrote."""
    from acctframe.streaming import ingest

    root = shared.new_path(spark, "ingest")
    schema = views.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).format("parquet").load(f"{d}/events.parquet*")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    updates = raw.select(F.col("user_id").alias("pubkey"), F.col("event_type").alias("owner"), hour.alias("slot"), F.col("event_id").alias("write_version"))
    ingest.start_ingest(updates, f"{root}/delta", f"{root}/checkpoint").awaitTermination()
    return versions.latest(ingest.read_delta(spark, f"{root}/delta").drop("batch", "slot_bucket")).groupBy("owner").agg(F.count("*").alias("n"))

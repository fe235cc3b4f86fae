"""The star schema's tables with account semantics; see the queries in catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blob_docs(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select(F.col("doc_id").alias("pubkey"), F.col("source").alias("owner"), data.alias("data"), F.octet_length(data).cast("long").alias("data_len"), F.col("n_chars").alias("lamports"))


def blob_parts(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode("p_name", "UTF-8")
    return table(spark, d, "part").select(F.col("p_partkey").alias("pubkey"), F.col("p_brand").alias("owner"), data.alias("data"), F.octet_length(data).cast("long").alias("data_len"), F.col("p_retailprice").alias("lamports"), F.col("p_size").cast("long").alias("slot"))


def upd_events(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return table(spark, d, "events").select(F.col("user_id").alias("pubkey"), F.col("event_type").alias("owner"), hour.alias("slot"), F.col("event_id").alias("write_version"), F.col("value").alias("lamports"), F.encode("props", "UTF-8").alias("data"))


def base_cust(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pubkey"), F.col("c_mktsegment").alias("owner"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("write_version"), F.col("c_acctbal").alias("lamports"), F.lit("base").alias("storage_type"))


def upd_orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("pubkey"), F.col("o_orderpriority").alias("owner"), day.alias("slot"), F.col("o_orderkey").alias("write_version"), F.col("o_totalprice").alias("lamports"), F.lit("delta").alias("storage_type"))


def tok_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("token_owner"), F.col("l_quantity").alias("amount"), F.col("l_orderkey").alias("pubkey"), F.col("l_linenumber").cast("long").alias("line"))


def deps_conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pubkey"))


def key32(number) -> Column:
    """A number as a key of 32 bytes: its digits, with zeros before them."""
    return F.encode(F.lpad(number.cast("string"), 32, "0"), "UTF-8")


def key_number(key) -> Column:
    return F.decode(F.col(key) if isinstance(key, str) else key, "UTF-8").cast("long")


def owner32(text) -> Column:
    return F.encode(F.rpad(text, 32, " "), "UTF-8")


def tok_data(spark: SparkSession, d: str) -> DataFrame:
    """Line items as token accounts: 72 bytes of mint (part), owner (supplier) and amount (quantity, below 128, little-endian); mint and token
    owner are columns too, as a writer stores what queries look up."""
    amount = F.encode(F.concat(F.char(F.col("l_quantity").cast("long")), F.lit("\0" * 7)), "UTF-8")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pubkey"), F.col("l_linenumber").cast("long").alias("line"), F.lit("token").alias("owner"), F.concat(key32(F.col("l_partkey")), key32(F.col("l_suppkey")), amount).alias("data"), key32(F.col("l_partkey")).alias("mint"), key32(F.col("l_suppkey")).alias("token_owner"))


def part_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as whole accounts of the base layer: 32-byte keys and owners, the name as data, the size as slot and lamports."""
    p = table(spark, d, "part")
    return p.select(key32(F.col("p_partkey")).alias("pubkey"), F.col("p_size").cast("decimal(20,0)").alias("lamports"), F.encode("p_name", "UTF-8").alias("data"), owner32(F.col("p_brand")).alias("owner"), (F.col("p_size") % 2 == 0).alias("executable"), F.col("p_size").cast("long").alias("slot"), F.lit(0).cast("long").alias("write_version"), F.lit(0).cast("decimal(20,0)").alias("rent_epoch"), F.lit("base").alias("storage_type"))


def part_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates of the parts above size 40, at slot 1000: names in upper case, more lamports, and another owner above size 45; each
    comes after an older one that is superseded."""
    p = part_accounts(spark, d).where("slot > 40")
    owner = F.when(F.col("slot") > 45, owner32(F.lit("Brand#99"))).otherwise(F.col("owner"))
    new = p.withColumns({"data": F.encode(F.upper(F.decode("data", "UTF-8")), "UTF-8"), "owner": owner, "lamports": (F.col("lamports") + 1000).cast("decimal(20,0)"), "slot": F.lit(1000).cast("long"), "write_version": F.lit(2).cast("long"), "storage_type": F.lit("delta")})
    return new.unionByName(new.withColumns({"write_version": F.lit(1).cast("long"), "owner": owner32(F.lit("Brand#98")), "lamports": F.lit(1).cast("decimal(20,0)")}))


#: The same views for DuckDB.
SQL = {
    "blob_docs": "SELECT doc_id AS pubkey, source AS owner, encode(text) AS data, CAST(strlen(text) AS BIGINT) AS data_len, n_chars AS lamports FROM documents",
    "blob_parts": "SELECT p_partkey AS pubkey, p_brand AS owner, encode(p_name) AS data, CAST(strlen(p_name) AS BIGINT) AS data_len, p_retailprice AS lamports, CAST(p_size AS BIGINT) AS slot FROM part",
    "upd_events": "SELECT user_id AS pubkey, event_type AS owner, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id AS write_version, value AS lamports, encode(props) AS data FROM events",
    "base_cust": "SELECT c_custkey AS pubkey, c_mktsegment AS owner, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS write_version, c_acctbal AS lamports, 'base' AS storage_type FROM customer",
    "upd_orders": "SELECT o_custkey AS pubkey, o_orderpriority AS owner, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS slot, o_orderkey AS write_version, o_totalprice AS lamports, 'delta' AS storage_type FROM orders",
    "tok_lineitem": "SELECT l_partkey AS mint, l_suppkey AS token_owner, l_quantity AS amount, l_orderkey AS pubkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem",
    "part_state": "SELECT p_partkey AS pubkey, CASE WHEN p_size > 45 THEN 'Brand#99' ELSE p_brand END AS owner, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS data, CAST(CASE WHEN p_size > 40 THEN 1000 ELSE p_size END AS BIGINT) AS slot, CAST(CASE WHEN p_size > 40 THEN p_size + 1000 ELSE p_size END AS BIGINT) AS lamports FROM part",
    "deps_conv": "SELECT conv_id AS query_id, turn AS pubkey FROM conversations",
}

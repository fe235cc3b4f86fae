"""Statistics of indexes, tiers, segments and caches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acctframe.functions import codecs
from acctframe.functions import columns as C


def cardinality(accounts: DataFrame, key: str | Column, alias: str = "key") -> DataFrame:
    """Accounts per key."""
    value = F.col(key) if isinstance(key, str) else key
    return accounts.select(value.alias(alias)).where(F.col(alias).isNotNull()).groupBy(alias).agg(F.count("*").alias("n_accounts"))


def index_totals(accounts: DataFrame, indexes: dict[str, Column]) -> DataFrame:
    """index, unique_keys, n_accounts: rows are unpivoted once, not read once per index."""
    entries = F.array(*[F.struct(F.lit(n).alias("index"), v.cast("string").alias("key")) for n, v in indexes.items()])
    flat = accounts.select(F.inline(entries)).where("key is not null")
    return flat.groupBy("index").agg(F.count_distinct("key").alias("unique_keys"), F.count("*").alias("n_accounts"))


def reducer_stats(updates: DataFrame, key: str = "pubkey") -> DataFrame:
    per_key = updates.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_updates"), F.count("*").alias("n_kept")).withColumn("n_dropped", F.col("n_updates") - F.col("n_kept"))


def offset_stats(tracked: DataFrame) -> DataFrame:
    """Per program and offset, per program, and over all: unique keys, entries and their mean."""
    out = tracked.rollup("owner", "offset").agg(F.count_distinct("bytes").alias("unique_keys"), F.count("*").alias("entries"))
    return out.withColumn("mean_entries", F.when(F.col("unique_keys") == 0, 0.0).otherwise(F.col("entries") / F.col("unique_keys")))


def touch(entries: DataFrame, accesses: DataFrame, key: str = "pubkey") -> DataFrame:
    """Entries (key, last_access) after accesses (key, slot): the last access only rises; keys that were not there come in."""
    both = entries.select(key, "last_access").unionByName(accesses.select(key, F.col("slot").alias("last_access")))
    return both.groupBy(key).agg(F.max("last_access").alias("last_access"))


def promote(entries: DataFrame, keys: DataFrame, current: int, key: str = "pubkey") -> DataFrame:
    """Entries after some of them were promoted: theirs counts as an access now, so they are hot and in no other tier."""
    up = entries.select(key).join(keys.select(key).distinct(), key, "left_semi").select(key, F.lit(current).cast("long").alias("slot"))
    return touch(entries, up, key)


def demote(entries: DataFrame, keys: DataFrame, current: int, to: str, key: str = "pubkey") -> DataFrame:
    """Entries after some were moved down to 'warm' or 'cold': their last access is as old as the tier asks for, at least."""
    down = keys.select(key).distinct().withColumn("__down", F.lit(True))
    limit = F.lit(current - {"warm": C.HOT_SLOTS, "cold": C.WARM_SLOTS}[to]).cast("long")
    joined = entries.join(down, key, "left")
    return joined.select(key, F.when(F.col("__down"), F.least("last_access", limit)).otherwise(F.col("last_access")).alias("last_access"))


def tier_counts(accounts: DataFrame, last_access: Column, current: Column, by: str = "owner") -> DataFrame:
    """Hot, warm and cold accounts and the hot share, per program and over all."""
    tiered = accounts.select(by, C.tier(last_access, current).alias("tier"))
    out = tiered.rollup(by).agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("hot", "warm", "cold")], F.count("*").alias("n_all"))
    return out.withColumn("hot_percent", F.when(F.col("n_all") == 0, 0.0).otherwise(F.col("n_hot") * 100.0 / F.col("n_all")))


def hit_rate(log: DataFrame, hit: str = "hit") -> DataFrame:
    return log.agg(F.count_if(hit).alias("hits"), F.count("*").alias("lookups")).withColumn("hit_rate", F.when(F.col("lookups") == 0, 0.0).otherwise(F.col("hits") / F.col("lookups")))


def mean_time(log: DataFrame, time: str) -> DataFrame:
    """Whole mean of times, 0 where there is none, and quantiles."""
    return log.agg(F.when(F.count(time) == 0, 0).otherwise(F.floor(F.sum(time) / F.count(time))).alias("mean_time"), F.percentile_approx(time, [0.5, 0.99]).alias("p50_p99"))


def moving_mean(times: Column) -> Column:
    """Folds an array of times by (mean + x) / 2."""
    return F.aggregate(times, F.lit(0.0), lambda mean, x: (mean + x) / 2)


def _folded(accounts: DataFrame, by: str, key: str, data: str, folder: type, name: str) -> DataFrame:
    """One text a group from its rows' (key, data) hashes, which come in key order; a group is whole in a task."""
    hashes = accounts.select(F.col(by).alias("by"), F.col(key).alias("k"), C.account_hash(key, data).alias("h"))
    ordered = hashes.repartition("by").sortWithinPartitions("by", "k", "h").select("by", "h")
    kind = T.StructType([T.StructField(by, accounts.schema[by].dataType), T.StructField(name, T.StringType())])
    return ordered.mapInArrow(partial(_fold, folder=folder, names=[by, name]), kind)


def _fold(batches: Iterator[pa.RecordBatch], folder: type, names: list[str]) -> Iterator[pa.RecordBatch]:
    now, fold, kind = None, None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([fold.done()])], names=names)
    for batch in batches:
        kind = batch.schema.field(0).type
        for by, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if fold is None or by != now:
                if fold is not None:
                    yield out()
                now, fold = by, folder()
            fold.add(h)
    if fold is not None:
        yield out()


class _Joined:
    """SHA-256 over hashes one after the other."""

    def __init__(self):
        self.state = hashlib.sha256()

    def add(self, h: bytes) -> None:
        self.state.update(h)

    def done(self) -> str:
        return self.state.hexdigest()


class _Tree:
    """Merkle root of hashes as they come: the roots of whole subtrees wait for a neighbour of their size."""

    def __init__(self):
        self.waiting: list[tuple[int, bytes]] = []

    def add(self, h: bytes) -> None:
        size = 1
        while self.waiting and self.waiting[-1][0] == size:
            h, size = codecs.node_hash(self.waiting.pop()[1], h), 2 * size
        self.waiting.append((size, h))

    def done(self) -> str:
        top = self.waiting.pop()[1]
        while self.waiting:
            top = codecs.node_hash(self.waiting.pop()[1], top)
        return top.hex()


def ordered_hash(accounts: DataFrame, by: str, key: str = "pubkey", data: str = "data") -> DataFrame:
    """One SHA-256 over (key, data) hashes in key order for each group.  Data is hashed before the shuffle; a group's hashes then
    pass through one task, which the order asks for, and are not held there."""
    return _folded(accounts, by, key, data, _Joined, "batch_sha256")


def merkle_roots(accounts: DataFrame, by: str, key: str = "pubkey", data: str = "data") -> DataFrame:
    """Merkle root over the (key, data) hashes of each group in key order; a task holds a path of the tree, not the group."""
    return _folded(accounts, by, key, data, _Tree, "root")


def largest_token_accounts(tokens: DataFrame, mint, n: int = 20) -> DataFrame:
    return tokens.where(F.col("mint") == mint).orderBy(F.desc("amount"), "pubkey").limit(n)

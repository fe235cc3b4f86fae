"""Algebra of account sets; a set is a DataFrame with one id column, or packed in bitmaps of dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acctframe import shared


def intersect(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One aggregate over both sides: ids that just one of them has."""
    name = a.columns[0]
    sided = a.distinct().select(F.col(name), F.lit(1).alias("side")).union(b.distinct().select(F.col(b.columns[0]), F.lit(2)))
    return sided.groupBy(name).agg(F.sum("side").alias("side")).where("side < 3").select(name)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """size_a, size_b, n_both, n_any and jaccard (0 if both are empty)."""
    name = a.columns[0]
    sided = a.distinct().select(F.col(name), F.lit(1).alias("side")).union(b.distinct().select(F.col(b.columns[0]), F.lit(2)))
    per_id = sided.groupBy(name).agg(F.sum("side").alias("side"))
    out = per_id.agg(F.count_if(F.col("side") != 2).alias("size_a"), F.count_if(F.col("side") != 1).alias("size_b"), F.count_if(F.col("side") == 3).alias("n_both"), F.count("*").alias("n_any"))
    return out.withColumn("jaccard", F.when(F.col("n_any") == 0, 0.0).otherwise(F.col("n_both") / F.col("n_any")))


def contains(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted id and whether the set holds it (there)."""
    name, asked = ids.columns[0], wanted.columns[0]
    have = ids.select(F.col(name).alias("__id")).distinct()
    return wanted.join(have, wanted[asked] == have["__id"], "left").select(asked, F.col("__id").isNotNull().alias("there"))


def insert(ids: DataFrame, more: DataFrame) -> DataFrame:
    return union(ids, more)


def remove(ids: DataFrame, gone: DataFrame) -> DataFrame:
    return difference(ids, gone)


def to_bitmaps(ids: DataFrame, key: str | None = None) -> DataFrame:
    """Posting table of dense ids from 1: (key,) bucket, bitmap."""
    name = [c for c in ids.columns if c != key][0]
    keys = [key] if key else []
    return ids.groupBy(*keys, F.bitmap_bucket_number(name).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("bitmap"))


def bitmap_and(postings: DataFrame, keys: list, key: str) -> DataFrame:
    """Buckets of the ids that all keys have: a bucket that misses a key drops out."""
    mine = postings.where(F.col(key).isin(keys))
    return mine.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count_distinct(key).alias("n")).where(F.col("n") == len(set(keys))).drop("n")


def bitmap_or(postings: DataFrame, keys: list, key: str) -> DataFrame:
    return postings.where(F.col(key).isin(keys)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_size(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """The ids (dense, from 1) that bitmaps hold, one row each: all set bits."""
    byte = lambda i: F.substring(F.col("bitmap"), i + 1, F.lit(1))
    used = F.filter(F.sequence(F.lit(0), F.octet_length("bitmap") - 1), lambda i: byte(i) != F.lit(bytearray(1)))
    each = bitmaps.select("bucket", "bitmap", F.explode(used).alias("i")).select("bucket", "i", F.conv(F.hex(byte(F.col("i"))), 16, 10).cast("int").alias("bits"))
    bits = each.select("bucket", "i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit("bits", b) == 1)).alias("b"))
    return bits.select(((F.col("bucket") - 1) * 32768 + F.col("i") * 8 + F.col("b") + 1).alias("id"))


def bitmap_first(bitmaps: DataFrame) -> DataFrame:
    """The least id that bitmaps hold, null if there is none: the first set bit."""
    return bitmap_ids(bitmaps).agg(F.min("id").alias("id"))


def bitmap_bytes(bitmaps: DataFrame) -> DataFrame:
    """buckets and bytes of serialized bitmaps."""
    return bitmaps.agg(F.count("*").alias("buckets"), F.coalesce(F.sum(F.octet_length("bitmap")), F.lit(0)).alias("bytes"))


def decode(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids with their keys, from a dictionary (key, id)."""
    return ids.join(known.select("id", key), "id")


class BitmapStore:
    """Posting tables by index name and key, as Parquet: each store() of an (index, key) replaces what was there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, index: str, postings: DataFrame, slot: int) -> None:
        """postings: key, bucket, bitmap (see to_bitmaps); each key's entry records its slot and its number of ids."""
        rows = postings.select(F.lit(index).alias("index"), F.col(postings.columns[0]).cast("string").alias("key"), "bucket", "bitmap", F.lit(slot).cast("long").alias("slot"), F.bitmap_count("bitmap").alias("n"))
        rows.write.mode("append").partitionBy("index").parquet(self.path)

    def rows(self) -> DataFrame:
        """The newest store of each key."""
        every = self.spark.read.schema("key string, bucket long, bitmap binary, slot long, n long, index string").parquet(self.path)
        newest = every.groupBy("index", "key").agg(F.max("slot").alias("slot"))
        return every.join(newest, ["index", "key", "slot"], "left_semi").where("bitmap is not null")

    def get(self, index: str, key) -> DataFrame:
        """bucket, bitmap of a key."""
        return self.rows().where((F.col("index") == index) & (F.col("key") == F.lit(str(key)))).select("bucket", "bitmap")

    def remove(self, index: str, keys: list, slot: int) -> None:
        """From this slot on the keys have no entry."""
        gone = self.spark.range(1, numPartitions=1).select(F.lit(index).alias("index"), F.explode(F.array(*[F.lit(str(k)) for k in keys])).alias("key"))
        none = gone.select("index", "key", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bitmap"), F.lit(slot).cast("long").alias("slot"), F.lit(0).cast("long").alias("n"))
        none.write.mode("append").partitionBy("index").parquet(self.path)

    def stats(self) -> DataFrame:
        """index, keys, ids and bytes."""
        return self.rows().groupBy("index").agg(F.count_distinct("key").alias("keys"), F.sum("n").alias("ids"), F.sum(F.octet_length("bitmap")).alias("bytes"))


def dictionary(keys: DataFrame, key: str, first_seen: str, start: int = 1) -> DataFrame:
    """Dense ids in order of first appearance, from `start`, without a single-task window.

    Keys are range-sorted and written once, numbered within their partition, and moved by the counts of the partitions before.
    """
    seen = keys.groupBy(key).agg(F.min(first_seen).alias("first_seen"))
    ranged = shared.stored(seen.repartitionByRange(F.col("first_seen"), F.col(key)).withColumn("part", F.spark_partition_id()), "dictionary")
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("first_seen", key)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = ranged.groupBy("part").agg(F.count("*").alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return local.join(base.select("part", "base"), "part").select(key, (F.col("n") + F.col("base") + (start - 1)).alias("id"))


def extend_dictionary(known: DataFrame, keys: DataFrame, key: str, first_seen: str) -> DataFrame:
    """A stored dictionary (key, id) and its new keys, whose ids go on from the largest there is."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.unionByName(dictionary(keys.join(known, key, "left_anti"), key, first_seen, start=top + 1))


class PersistentDictionary:
    """A dictionary as a Parquet table (key, id) that grows: ids stay, new keys go on from the largest one."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, f"{key} {kind}, id long"

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if shared.exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def grow(self, keys: DataFrame, first_seen: str) -> int:
        """Gives ids to keys that have none; returns how many there were."""
        known = self.table()
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = dictionary(keys.join(known, self.key, "left_anti"), self.key, first_seen, start=top + 1)
        fresh.write.mode("append").parquet(self.path)
        return self.table().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] - top

    def ids_of(self, keys: DataFrame) -> DataFrame:
        """Each key with its id, null where it has none."""
        return keys.join(self.table(), self.key, "left")

    def keys_of(self, ids: DataFrame) -> DataFrame:
        return decode(ids, self.table(), self.key)


def first_n(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy(ids.columns[0]).limit(n)


def with_deltas(base: DataFrame, deltas: list[DataFrame], removed: DataFrame | None = None) -> DataFrame:
    """Ids of a base and its deltas; a removed id is hidden wherever it stands."""
    every = union(base, *deltas)
    return every if removed is None else difference(every, removed)


def log_entries(ids: DataFrame, seq, kept: bool = True) -> DataFrame:
    """Ids as entries of a log of insertions (kept) and removals: id, seq, kept."""
    return ids.select(F.col(ids.columns[0]).alias("id"), (seq if not isinstance(seq, int) else F.lit(seq)).cast("long").alias("seq"), F.lit(kept).alias("kept"))


def layered(base: DataFrame, log: DataFrame) -> DataFrame:
    """Ids of a base under a log: of each id the newest entry counts, so one that is inserted again after its removal is back."""
    entries = log_entries(base, -1).unionByName(log.select("id", "seq", "kept"))
    newest = entries.groupBy("id").agg(F.max_by("kept", F.struct("seq", "kept")).alias("kept"))
    return newest.where("kept").select("id")


def compact_log(base: DataFrame, log: DataFrame, up_to: int) -> tuple[DataFrame, DataFrame]:
    """(new base, remaining log): entries up to a number go into the base."""
    return layered(base, log.where(F.col("seq") <= up_to)), log.where(F.col("seq") > up_to)


def words_and(a, b):
    """Bitwise and of two arrays of words, to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.bitwiseAND(y))


def _padded(a, b, f):
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def words_or(a, b, shortest: bool = False):
    """Bitwise or of two arrays of words, to the longer one's length, or to the shorter's."""
    if shortest:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return _padded(a, b, lambda x, y: x.bitwiseOR(y))


def words_xor(a, b):
    return _padded(a, b, lambda x, y: x.bitwiseXOR(y))


def popcount(words):
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def first_set(words):
    """Place of the first set bit of an array of 64-bit words, null if there is none."""
    return F.array_min(all_set(words))


def all_set(words):
    """Places of all set bits of an array of 64-bit words, in order."""
    bits = F.transform(words, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w, b) == 1), lambda b: (i * 64 + b).cast("long")))
    return F.flatten(bits)


def merge_sorted(a, b):
    """Sorted union of two sorted arrays: a value occurs as often as in the array that holds it more often."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    each = F.transform(F.array_union(a, b), lambda v: F.array_repeat(v, F.greatest(count(a, v), count(b, v))))
    return F.array_sort(F.flatten(each))

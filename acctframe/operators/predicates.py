"""Account filters.  All filters of a query are one conjunction, so Catalyst pushes what it can into the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.functions import codecs
from acctframe.functions import columns as C

#: (offset, length) presets of byte matches that writers can materialize, and those of a program without its own (fixed values).
PRESETS = {"discriminator": (0, 8), "owner": (32, 32), "mint": (64, 32), "flag": (1, 32)}
DEFAULT_PRESETS = ("discriminator", "owner")


def preset_offsets(*names: str, custom: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Places to track: presets by name (the default ones if none) and custom ones, without those of no bytes."""
    return [p for p in [*(PRESETS[n] for n in names or DEFAULT_PRESETS), *custom] if p[1] > 0]


def at_name(offset: int, length: int) -> str:
    """Column that holds the materialized bytes of a place."""
    return "discriminator" if (offset, length) == PRESETS["discriminator"] else f"at_{offset}_{length}"


@dataclass(frozen=True)
class DataSize:
    size: int

    def column(self, have: set[str]) -> Column:
        return (F.col("data_len") if "data_len" in have else C.data_size()) == self.size


@dataclass(frozen=True)
class Memcmp:
    offset: int
    bytes: bytes

    def column(self, have: set[str]) -> Column:
        n = len(self.bytes)
        if at_name(self.offset, n) in have:
            return F.col(at_name(self.offset, n)) == C.binary(self.bytes)
        if not n:
            return F.octet_length("data") >= self.offset
        return (F.octet_length("data") >= self.offset + n) & (F.substring("data", self.offset + 1, n) == C.binary(self.bytes))


@dataclass(frozen=True)
class Discriminator:
    bytes: bytes

    def column(self, have: set[str]) -> Column:
        return (F.col("discriminator") if "discriminator" in have else C.discriminator()) == C.binary(self.bytes)


@dataclass(frozen=True)
class TokenField:
    """Mint or token owner of token accounts."""

    name: str
    bytes: bytes
    program: object = field(default=None)

    def column(self, have: set[str]) -> Column:
        value = F.col(self.name) if self.name in have else C.token_columns()[self.name]
        match = value == C.binary(self.bytes)
        return match if self.program is None else match & C.is_token(F.col("owner"), "data", F.lit(self.program))


def conjunction(filters: list, have: set[str]) -> Column:
    out = F.lit(True)
    for f in filters:
        out &= f.column(have)
    return out


def program_accounts(accounts: DataFrame, program, filters: list = (), missing_index: str = "empty") -> DataFrame:
    """Accounts of a program that pass all filters.

    missing_index="skip" leaves out filters whose key no account has, as a compatible mode; normally such a filter
    leaves nothing.
    """
    have, kept = set(accounts.columns), list(filters)
    if missing_index == "skip" and kept:
        found = accounts.agg(*[F.coalesce(F.bool_or(f.column(have)), F.lit(False)) for f in kept]).first()
        kept = [f for f, any_of in zip(kept, found, strict=True) if any_of]
    return accounts.where(program_match(program, kept)(have))


def program_match(program, filters: list = ()):
    """The condition of program_accounts, for versions.matching."""
    return lambda have: (F.col("owner") == literal(program)) & conjunction(list(filters), have)


def literal(value) -> Column:
    return C.binary(value) if isinstance(value, bytes) else F.lit(value)


def account(accounts: DataFrame, key) -> DataFrame:
    return accounts.where(F.col("pubkey") == literal(key)).limit(1)


def requested(spark: SparkSession, keys: list, kind: str, most: int = 1000) -> DataFrame:
    """pos and key of each request, as one row of literals that the optimizer unfolds."""
    if len(keys) > most:
        raise ValueError(f"more than {most} keys")
    every = F.array(*[literal(k).cast(kind) for k in keys]) if keys else F.array().cast(f"array<{kind}>")
    return spark.range(1, numPartitions=1).select(F.posexplode(every).alias("pos", "key")).withColumn("pos", F.col("pos").cast("long"))


def in_request_order(asked: DataFrame, found: DataFrame) -> DataFrame:
    """One row per requested key, in order (pos); the rest is null for keys that are not there."""
    return asked.join(found, asked.key == found.pubkey, "left").orderBy("pos")


def multiple_accounts(spark: SparkSession, accounts: DataFrame, keys: list, most: int = 1000) -> DataFrame:
    """One row per requested key, in order; the keys, `most` literals at most, go into the scan."""
    asked = requested(spark, keys, accounts.schema["pubkey"].dataType.simpleString(), most)
    return in_request_order(asked, accounts.where(F.col("pubkey").isin([literal(k) for k in dict.fromkeys(keys)])) if keys else accounts.limit(0))


def missing_keys(answer: DataFrame) -> DataFrame:
    """The distinct requested keys of multiple_accounts that are not there, in order of request."""
    return answer.where("pubkey is null").groupBy("key").agg(F.min("pos").alias("pos")).orderBy("pos").select("key")


def with_index_columns(accounts: DataFrame, offsets: list[tuple[int, int]] = ()) -> DataFrame:
    """Materializes what queries look up, so that scans can push it down; offsets are further places of byte matches."""
    out = accounts.withColumn("data_len", C.data_size()).withColumn("discriminator", C.discriminator())
    return out.withColumns({at_name(o, n): C.bytes_at("data", o, n) for o, n in offsets if n > 0}) if offsets else out


def keys_of(accounts: DataFrame, index: str | Column, alias: str = "key") -> DataFrame:
    """The distinct keys of an index, in order."""
    value = F.col(index) if isinstance(index, str) else index
    return accounts.select(value.alias(alias)).where(F.col(alias).isNotNull()).distinct().orderBy(alias)


def tracked_offsets(accounts: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The byte-match table: owner, offset, length, bytes, pubkey for each tracked (offset, length) that an account's data covers."""
    entries = F.array(*[F.struct(F.lit(o).cast("long").alias("offset"), F.lit(n).cast("long").alias("length"), C.bytes_at("data", o, n).alias("bytes")) for o, n in offsets if n > 0])
    return accounts.select("owner", "pubkey", F.inline(F.filter(entries, lambda e: e.bytes.isNotNull())))


def tracked_places(tracked: DataFrame) -> DataFrame:
    """The places that the byte-match table holds, by program."""
    return tracked.select("owner", "offset", "length").distinct()


def accelerated_memcmp(accounts: DataFrame, tracked: DataFrame, offsets: list[tuple[int, int]], program, offset: int, value: bytes) -> DataFrame:
    """Accounts of a program with these bytes: through the byte-match table where it tracks the place, else by their data."""
    if (offset, len(value)) not in offsets or not value:
        return program_accounts(accounts, program, [Memcmp(offset, value)])
    hits = tracked.where((F.col("owner") == literal(program)) & (F.col("offset") == offset) & (F.col("length") == len(value)) & (F.col("bytes") == C.binary(value)))
    return accounts.where(F.col("owner") == literal(program)).join(hits.select("pubkey"), "pubkey", "left_semi")


def without_accounts(tracked: DataFrame, gone: DataFrame) -> DataFrame:
    """The byte-match table, or any table by pubkey, without some accounts."""
    return tracked.join(gone.select("pubkey"), "pubkey", "left_anti")


def metadata(accounts: DataFrame) -> DataFrame:
    """All fields but the data, of which only the length stays; scans then skip the data column where data_len is stored."""
    size = F.col("data_len") if "data_len" in accounts.columns else C.data_size()
    return accounts.select(*[c for c in accounts.columns if c not in ("data", "data_len")], size.alias("data_len"))


def to_plain(accounts: DataFrame) -> DataFrame:
    """What an account is outside the engine: key, lamports, data, owner, executable and rent epoch."""
    return accounts.select("pubkey", "lamports", "data", "owner", "executable", "rent_epoch")


def from_plain(plain: DataFrame, slot: Column, write_version: Column) -> DataFrame:
    """Plain accounts as versions that arrive at a slot."""
    return plain.withColumns({"slot": slot.cast("long"), "write_version": write_version.cast("long"), "storage_type": F.lit("delta")})


def from_updates(updates: DataFrame) -> DataFrame:
    """Updates as account versions of the delta layer: where in its block an update came from is left out."""
    return updates.drop("tx_index", "is_startup").withColumn("storage_type", F.lit("delta"))


def response_rows(accounts: DataFrame, encoding: str = "base64") -> DataFrame:
    """Accounts as responses show them: keys in base58, data encoded, the place left out.  Base58 has no built-in, so page first."""
    data = {"base64": F.base64("data"), "base58": codecs.to_base58("data"), "binary": F.col("data")}[encoding]
    return accounts.select(codecs.to_base58("pubkey").alias("pubkey"), codecs.to_base58("owner").alias("owner"), "lamports", data.alias("data"), F.lit(encoding).alias("encoding"), "executable", "rent_epoch", "slot", C.data_size().alias("space"))

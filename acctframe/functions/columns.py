"""Column functions of the account model; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from acctframe.schemas import CONFIRMATIONS, LAYERS, LEVELS

#: Slots since the last access below which an account is hot or warm (fixed values).
HOT_SLOTS, WARM_SLOTS = 100, 10_000
STALE_SLOTS = 100
#: Base58 of the token program's id (fixed value); pass another one where it differs.
TOKEN_PROGRAM = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
MINT, TOKEN_OWNER, AMOUNT = (0, 32), (32, 32), (64, 8)
TOKEN_BYTES = 72


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def data_size(data="data") -> Column:
    return F.octet_length(col(data)).cast("long")


def bytes_at(data, offset: int, length: int) -> Column:
    """The bytes [offset, offset + length) of data, null where data is shorter."""
    return F.when(F.octet_length(col(data)) >= offset + length, F.substring(col(data), offset + 1, length))


def discriminator(data="data") -> Column:
    return bytes_at(data, 0, 8)


def le_uint(data, offset: int, width: int) -> Column:
    """A little-endian unsigned number of `width` bytes as DECIMAL(20, 0), null where data is shorter."""
    pairs = F.regexp_extract_all(F.hex(bytes_at(data, offset, width)), F.lit("(..)"), F.lit(1))
    return F.conv(F.concat_ws("", F.reverse(pairs)), 16, 10).cast("decimal(20,0)")


def is_token(owner: Column, data, program: Column) -> Column:
    return (owner == program) & (F.octet_length(col(data)) >= TOKEN_BYTES)


def token_columns(data="data") -> dict[str, Column]:
    return {"mint": bytes_at(data, *MINT), "token_owner": bytes_at(data, *TOKEN_OWNER), "amount": le_uint(data, *AMOUNT)}


def version(slot="slot", write_version="write_version", layer: Column | str | None = None) -> Column:
    """Sorts as versions do: slot, then write version, then layer if given."""
    parts = [col(slot), col(write_version)]
    if layer is not None:
        parts.append(layer_rank(layer))
    return F.struct(*[p.alias(f"v{i}") for i, p in enumerate(parts)])


def layer_rank(storage_type="storage_type") -> Column:
    return F.coalesce(*[F.when(F.lower(col(storage_type)) == k, v) for k, v in LAYERS.items()], F.lit(-1))


def is_newer(slot: Column, wv: Column, than_slot: Column, than_wv: Column) -> Column:
    return (slot > than_slot) | ((slot == than_slot) & (wv > than_wv))


def is_at_least(slot: Column, wv: Column, than_slot: Column, than_wv: Column) -> Column:
    return (slot > than_slot) | ((slot == than_slot) & (wv >= than_wv))


def tier(last_access: Column, current: Column) -> Column:
    age = current - last_access
    return F.when(age < HOT_SLOTS, "hot").when(age < WARM_SLOTS, "warm").otherwise("cold")


def lagged_slots(processed: Column) -> dict[str, Column]:
    """Confirmed and finalized slots where only the processed one is known."""
    return {"processed": processed, "confirmed": F.when(processed > 1, processed - 1).otherwise(0), "finalized": F.when(processed > 31, processed - 31).otherwise(0)}


def watermark(level: str, processed: Column, confirmed: Column, finalized: Column) -> Column:
    return (processed, confirmed, finalized)[LEVELS[level]]


def satisfies(level: Column, wanted: str) -> Column:
    return F.coalesce(*[F.when(F.lower(level) == k, v) for k, v in LEVELS.items()]) >= LEVELS[wanted]


def min_confirmations(level: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(level) == k, v) for k, v in CONFIRMATIONS.items()])


def read_range(offset="offset", stored_size="stored_size") -> tuple[Column, Column]:
    return col(offset), col(offset) + col(stored_size)


def data_range(offset="offset", data_offset="data_offset", data_len="data_len") -> tuple[Column, Column]:
    return col(offset) + col(data_offset), col(offset) + col(data_offset) + col(data_len)


def sha256(data) -> Column:
    return F.unhex(F.sha2(col(data), 256))


def account_hash(pubkey="pubkey", data="data") -> Column:
    return sha256(F.concat(col(pubkey), col(data)))


def metadata_hash(pubkey="pubkey", lamports="lamports", owner="owner", slot="slot") -> Column:
    """SHA-256 of an account's fields without its data."""
    return sha256(F.concat_ws("|", F.hex(col(pubkey).cast("binary")), col(lamports).cast("string"), F.hex(col(owner).cast("binary")), col(slot).cast("string")).cast("binary"))


def verify(data, expected) -> Column:
    """Whether data has this SHA-256 (32 bytes); null where either is."""
    return sha256(data) == col(expected)


def query_key(parts: Iterable[Column]) -> Column:
    """A hash of a query that does not depend on the order of its filters."""
    return F.sha2(F.concat_ws("&", F.array_sort(F.array(*parts))), 256)


def is_expired(created: Column, ttl: Column, now: Column) -> Column:
    """A time to live of 0 has expired from the start."""
    return (ttl == 0) | (now > created + ttl)


def is_outdated(entry_slot: Column, current: Column, threshold: int = STALE_SLOTS) -> Column:
    return current > entry_slot + threshold


def align8(x: Column) -> Column:
    return F.floor((x + 7) / 8) * 8


def cursor_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def to_response(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

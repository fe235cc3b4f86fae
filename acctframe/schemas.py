"""Record types of the account model."""

from __future__ import annotations

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)

LOCATION = T.StructType([T.StructField(n, T.LongType()) for n in ("file_id", "offset", "stored_size", "data_offset", "data_len", "slot", "write_version")] + [T.StructField("storage_type", T.StringType())])

ACCOUNTS = T.StructType([
    T.StructField("pubkey", T.BinaryType()),
    T.StructField("lamports", U64),
    T.StructField("data", T.BinaryType()),
    T.StructField("owner", T.BinaryType()),
    T.StructField("executable", T.BooleanType()),
    T.StructField("slot", T.LongType()),
    T.StructField("write_version", T.LongType()),
    T.StructField("rent_epoch", U64),
    T.StructField("storage_type", T.StringType()),
    T.StructField("location", LOCATION),
])

#: An update as it arrives: an account without a place, and where in its block it came from.
UPDATES = T.StructType([f for f in ACCOUNTS.fields if f.name not in ("storage_type", "location")] + [T.StructField("tx_index", T.LongType()), T.StructField("is_startup", T.BooleanType())])

#: Layers by rising precedence among equal (slot, write_version).
LAYERS = {"base": 0, "compacted": 1, "delta": 2}
#: Commitment levels by rising strength, and the confirmations that they nominally need.
LEVELS = {"processed": 0, "confirmed": 1, "finalized": 2}
CONFIRMATIONS = {"processed": 0, "confirmed": 1, "finalized": 31}
ENCODINGS = ("binary", "base58", "base64", "base64+zstd", "jsonParsed")
SORT_ORDERS = ("pubkey", "lamports", "data_size", "slot_desc")

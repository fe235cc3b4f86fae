"""Sorting and stable pages: keyset cursors that pin the slot at which a result was read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from acctframe.functions import codecs

DEFAULT_LIMIT, RICH_LIMIT, MAX_LIMIT = 100, 1000, 1000


def clamp(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    return max(0, min(default if limit is None else limit, most))


def sort_columns(order: str) -> list[Column]:
    """Sort keys, with the key of the account as the last."""
    first = {"pubkey": [], "lamports": [F.col("lamports")], "data_size": [F.octet_length("data")], "slot_desc": [F.col("slot").desc()]}
    return [*first[order], F.col("pubkey")]


def sort_accounts(accounts: DataFrame, order: str = "pubkey") -> DataFrame:
    return accounts.orderBy(*sort_columns(order))


@dataclass
class Page:
    rows: list[Row]
    next_cursor: str | None
    has_more: bool
    is_last_page: bool
    total_count: int | None = None


def page(accounts: DataFrame, limit: int | None = None, cursor: str | None = None, order: str = "pubkey", slot: int | None = None, total: bool = False) -> Page:
    """The rows after a cursor.  A full page has a cursor; has_more comes from one row more than asked for.

    A cursor that cannot be read, or is of another order, starts from the first row.
    """
    n, after = clamp(limit), codecs.decode_cursor(cursor)
    keyed = accounts.withColumns({"__key": F.col("pubkey"), "__sort": {"pubkey": F.lit(0), "lamports": F.col("lamports"), "data_size": F.octet_length("data"), "slot_desc": -F.col("slot")}[order]})
    rest = keyed
    if after and after.get("order") == order:
        key = F.unhex(F.lit(after["key"])) if after["binary"] else F.lit(after["key"])
        kind = keyed.schema["__sort"].dataType
        last = F.lit(after["sort"]).cast(kind)
        rest = keyed.where((F.col("__sort") > last) | ((F.col("__sort") == last) & (F.col("__key") > key)))
    rows = rest.orderBy("__sort", "__key").limit(n + 1).collect()
    more, rows = len(rows) > n, rows[:n]
    mark = None
    if rows and len(rows) == n:
        key = rows[-1]["__key"]
        raw = isinstance(key, (bytes, bytearray))
        mark = codecs.encode_cursor(order=order, key=key.hex() if raw else key, binary=raw, sort=str(rows[-1]["__sort"]), slot=slot)
    fields = accounts.columns
    return Page([Row(**{f: r[f] for f in fields}) for r in rows], mark, more, len(rows) < n, accounts.count() if total else None)


def offset_page(accounts: DataFrame, offset: int, limit: int | None = None, order: str = "pubkey") -> DataFrame:
    return sort_accounts(accounts, order).offset(offset).limit(clamp(limit))

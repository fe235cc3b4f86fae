"""The read interface: engine facade, request validation, JSON-RPC dispatch without HTTP."""

from __future__ import annotations

import time
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.cache import PointCache
from acctframe.functions import codecs
from acctframe.functions import columns as C
from acctframe.functions.columns import TOKEN_PROGRAM
from acctframe.operators import predicates as P
from acctframe.operators import versions
from acctframe.plans import paging, planner
from acctframe.schemas import ENCODINGS, LEVELS
from acctframe.streaming.ingest import CommitmentState

#: Error codes of the protocol (fixed values).
PARSE, NO_METHOD, BAD_PARAMS, INTERNAL, RATE = -32700, -32601, -32602, -32603, -32005


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class RateLimiter:
    """At most `rate` calls of a client within any second; clients that were silent for a second are forgotten."""

    def __init__(self, rate: int, clock=time.monotonic, most_clients: int = 10_000):
        self.rate, self.clock, self.most_clients, self.calls = rate, clock, most_clients, defaultdict(deque)

    def allow(self, client: str) -> bool:
        now = self.clock()
        if len(self.calls) > self.most_clients:
            for silent in [c for c, times in self.calls.items() if not times or now - times[-1] >= 1]:
                del self.calls[silent]
        calls = self.calls[client]
        while calls and now - calls[0] >= 1:
            calls.popleft()
        if len(calls) >= self.rate:
            return False
        calls.append(now)
        return True


@dataclass(frozen=True)
class Call:
    """One entry of the query log."""

    method: str
    seconds: float
    columns: tuple[str, ...] = ()
    returned: int = 0


class Engine:
    """Queries over layers of account versions at a commitment level.

    Keys and filters go into the scans of both layers before these are merged; only accounts() merges all."""

    #: Calls that the query log holds.
    MOST_CALLS = 100_000

    def __init__(self, spark: SparkSession, base: DataFrame, delta: DataFrame | None = None, state: CommitmentState | None = None, rate: int = 1000, clock=time.monotonic):
        self.spark, self.base, self.delta = spark, base, delta
        self.state = state or CommitmentState()
        self.cache, self.limiter = PointCache(), RateLimiter(rate, clock)
        self.log: deque[Call] = deque(maxlen=self.MOST_CALLS)
        self._asked: tuple[tuple[str, ...], int] = ((), 0)

    def _layers(self, level: str) -> tuple[DataFrame, DataFrame | None, int]:
        return self.base, None if self.delta is None else self.state.visible_delta(self.delta), self.state.watermark(level)

    def accounts(self, level: str = "processed") -> DataFrame:
        base, delta, up_to = self._layers(level)
        if delta is None:
            return versions.visible(base, up_to)
        return versions.merge_delta(versions.visible(base, up_to), versions.visible(delta, up_to))

    def account(self, key, level: str = "processed") -> DataFrame:
        base, delta, up_to = self._layers(level)
        return versions.lookup(base, delta, [P.literal(key)], up_to).limit(1)

    def multiple_accounts(self, keys: list, level: str = "processed") -> DataFrame:
        base, delta, up_to = self._layers(level)
        asked = P.requested(self.spark, keys, base.schema["pubkey"].dataType.simpleString())
        found = versions.lookup(base, delta, [P.literal(k) for k in dict.fromkeys(keys)], up_to) if keys else base.limit(0)
        return P.in_request_order(asked, found)

    def matching(self, match, level: str = "processed") -> DataFrame:
        base, delta, up_to = self._layers(level)
        return versions.matching(base, delta, up_to, match)

    def of_program(self, program, filters: list = (), level: str = "processed") -> DataFrame:
        """All accounts of a program that pass the filters, the more selective ones first."""
        return self.matching(P.program_match(program, planner.by_selectivity(filters)), level)

    def program_accounts(self, program, filters: list = (), level: str = "processed", **page) -> paging.Page:
        return paging.page(self.of_program(program, filters, level), slot=self.state.watermark(level), **page)

    def rows(self, program, filters: list = (), level: str = "processed"):
        """An iterator over all rows of a program query: partition by partition where many are expected, else at once."""
        found = self.of_program(program, filters, level)
        return found.toLocalIterator() if planner.estimate(self.base.count(), list(filters)).streaming else iter(found.collect())

    def token_accounts(self, field: str, value: bytes, level: str = "processed", program: bytes | None = None) -> DataFrame:
        owner = bytearray(program or codecs.base58_decode(TOKEN_PROGRAM))
        return self.matching(lambda have: P.TokenField(field, value, owner).column(have), level)

    def largest_token_accounts(self, mint: bytes, level: str = "processed", n: int = 20) -> DataFrame:
        held = self.token_accounts("mint", mint, level)
        return held.withColumn("amount", C.token_columns()["amount"]).orderBy(F.desc("amount"), "pubkey").limit(n)

    def changed(self, keys: list) -> int:
        """Drops what the cache holds of accounts that have changed; ingestion calls it with a batch's keys."""
        return self.cache.invalidate(*keys)

    def explain(self, program: bytes, filters: list, level: str = "processed") -> planner.Plan:
        return planner.plan(planner.collect_statistics(self.accounts(level), [program], filters), program, filters)

    # JSON-RPC

    def rpc(self, request: dict, client: str = "local") -> dict:
        began, request_id = time.monotonic(), request.get("id") if isinstance(request, dict) else None
        try:
            if not isinstance(request, dict) or "method" not in request:
                raise RpcError(PARSE, "no request")
            if not self.limiter.allow(client):
                raise RpcError(RATE, "too many requests")
            method = {"getAccountInfo": self._account_info, "getMultipleAccounts": self._multiple, "getProgramAccounts": self._program, "getProgramAccountsV2": self._program_v2, "getTokenAccountsByOwner": self._by_owner, "getTokenAccountsByMint": self._by_mint, "getTokenLargestAccounts": self._largest}.get(request["method"])
            if method is None:
                raise RpcError(NO_METHOD, f"no method {request['method']}")
            params = request.get("params")
            if not isinstance(params, list) or not params:
                raise RpcError(BAD_PARAMS, "params must be an array")
            self._asked = ((), 0)
            out = {"result": method(*params[:2])}
        except RpcError as e:
            out = {"error": {"code": e.code, "message": str(e)}}
        except (TypeError, ValueError, KeyError) as e:
            out = {"error": {"code": BAD_PARAMS, "message": str(e)}}
        self.log.append(Call(str(request.get("method") if isinstance(request, dict) else None), time.monotonic() - began, *self._asked))
        return {"jsonrpc": "2.0", "id": request_id, **out}

    def _options(self, options: dict | None) -> tuple[str, str, bool]:
        o = options or {}
        encoding, level = o.get("encoding", "base64"), o.get("commitment", "processed")
        if encoding not in ENCODINGS or level not in LEVELS:
            raise RpcError(BAD_PARAMS, f"encoding {encoding} or commitment {level}")
        return encoding, level, o.get("withContext", True)

    def _key(self, text) -> bytes:
        raw = codecs.base58_decode(text)
        if len(raw) != 32:
            raise RpcError(BAD_PARAMS, f"no key: {text}")
        return raw

    def _value(self, row, encoding: str) -> dict | None:
        if row is None or row["pubkey"] is None:
            return None
        data = bytes(row["data"] or b"")
        return {"pubkey": codecs.base58_encode(bytes(row["pubkey"])), "owner": codecs.base58_encode(bytes(row["owner"])), "lamports": int(row["lamports"]), "data": [codecs.encode_data(data, encoding), encoding], "executable": row["executable"], "rentEpoch": int(row["rent_epoch"] or 0), "slot": row["slot"], "space": len(data)}

    def _answer(self, value, level: str, context: bool):
        return {"context": {"slot": self.state.watermark(level)}, "value": value} if context else value

    def _account_info(self, key: str, options: dict | None = None):
        raw, (encoding, level, context) = self._key(key), self._options(options)
        slot = self.state.watermark(level)
        cached = self.cache.get((raw, encoding, level), slot)
        if cached is None:
            row = self.account(raw, level).first()
            cached = (self._value(row, encoding),)
            self.cache.put((raw, encoding, level), cached, slot)
            self._asked = (("pubkey",), int(row is not None))
        return self._answer(cached[0], level, context)

    def _multiple(self, keys: list, options: dict | None = None):
        if not isinstance(keys, list) or len(keys) > 1000:
            raise RpcError(BAD_PARAMS, "a list of at most 1000 keys")
        encoding, level, context = self._options(options)
        if not keys:
            return self._answer([], level, context)
        rows = self.multiple_accounts([self._key(k) for k in keys], level).collect()
        self._asked = (("pubkey",), len(rows))
        return self._answer([self._value(r, encoding) for r in rows], level, context)

    def _filters(self, options: dict | None) -> list:
        out = []
        for f in (options or {}).get("filters", []):
            if "dataSize" in f:
                out.append(P.DataSize(f["dataSize"]))
            if "memcmp" in f:
                m = f["memcmp"]
                out.append(P.Memcmp(m["offset"], codecs.decode_bytes(m["bytes"], m.get("encoding", "hex"))))
            program = bytearray(codecs.base58_decode(TOKEN_PROGRAM))
            for name, field in (("mint", "mint"), ("tokenOwner", "token_owner")):
                if name in f:
                    out.append(P.TokenField(field, self._key(f[name]), program))
        return out

    def _paged(self, found: DataFrame, columns: tuple[str, ...], options: dict | None):
        """A page of rows; where there are more, the context has the cursor that the options of the next request name."""
        (encoding, level, context), o = self._options(options), options or {}
        slot = self.state.watermark(level)
        p = paging.page(found, limit=paging.clamp(o.get("limit"), paging.RICH_LIMIT), cursor=o.get("cursor"), order="pubkey", slot=slot)
        self._asked = (columns, len(p.rows))
        value = [self._value(r, encoding) for r in p.rows]
        return {"context": {"slot": slot, "cursor": p.next_cursor}, "value": value} if p.has_more else self._answer(value, level, context)

    def _program(self, program: str, options: dict | None = None):
        filters, (_, level, _) = self._filters(options), self._options(options)
        return self._paged(self.of_program(self._key(program), filters, level), ("owner", *map(planner.column_of, filters)), options)

    def _program_v2(self, program: str, options: dict | None = None):
        raw, (encoding, level, _), o = self._key(program), self._options(options), options or {}
        limit, filters = paging.clamp(o.get("limit"), paging.RICH_LIMIT), self._filters(o)
        p = self.program_accounts(raw, filters, level, limit=limit, cursor=o.get("cursor"), order=o.get("sort", "pubkey"))
        self._asked = (("owner", *map(planner.column_of, filters)), len(p.rows))
        return {"accounts": [self._value(r, encoding) for r in p.rows], "cursor": p.next_cursor, "hasMore": p.has_more, "slot": self.state.watermark(level)}

    def _by_owner(self, owner: str, options: dict | None = None):
        return self._paged(self.token_accounts("token_owner", self._key(owner), self._options(options)[1]), ("token_owner",), options)

    def _by_mint(self, mint: str, options: dict | None = None):
        return self._paged(self.token_accounts("mint", self._key(mint), self._options(options)[1]), ("mint",), options)

    def _largest(self, mint: str, options: dict | None = None):
        raw, (_, level, context) = self._key(mint), self._options(options)
        rows = self.largest_token_accounts(raw, level).collect()
        self._asked = (("mint",), len(rows))
        return self._answer([{"address": codecs.base58_encode(bytes(r["pubkey"])), "amount": str(r["amount"])} for r in rows], level, context)

    def health(self) -> dict:
        return {"status": "ok", "slot": self.state.processed, "root": self.state.root}

    def metrics(self) -> str:
        times = [c.seconds for c in self.log]
        values = {"requests_total": len(times), "cache_hit_rate": self.cache.hit_rate, "processed_slot": self.state.processed, "mean_seconds": sum(times) / len(times) if times else 0.0}
        return "".join(f"acctframe_{k} {v}\n" for k, v in values.items())

    def slow_requests(self, seconds: float) -> list[Call]:
        return [c for c in self.log if c.seconds >= seconds]

    def query_log(self) -> DataFrame:
        """One row per call: method, seconds, columns that it searched by, and rows that it returned."""
        return self.spark.createDataFrame([(c.method, c.seconds, list(c.columns), c.returned) for c in self.log], "method string, seconds double, columns array<string>, returned long")

    def advice(self) -> DataFrame:
        """What planner.advise_from_log makes of the log; a call scans the base, as far as the engine knows."""
        scanned = self.base.count()
        return planner.advise_from_log(self.query_log().select(F.explode("columns").alias("column"), F.lit(scanned).cast("long").alias("scanned")))

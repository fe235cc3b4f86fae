"""Filter order, selectivity and cost estimates, and advice on layouts.  Estimates never change results."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctframe.operators import sets
from acctframe.operators.predicates import DataSize, Discriminator, Memcmp

#: Cost weights and selectivities (fixed values).
LOOKUP, INTERSECT, FETCH, FILTER, BASE_COST = 10, 1, 2, 10, 100
SELECTIVITY = {DataSize: 0.1, Memcmp: 0.05, Discriminator: 0.01}
UNKNOWN_PROGRAM = 1_000_000
STREAM_ROWS = 1000
#: Advice thresholds: share and number of distinct keys, rows, queries and rows scanned (fixed values).
BTREE_SHARE, BITMAP_KEYS, BITMAP_ROWS, HASH_KEYS, LEAST_ROWS = 0.8, 1000, 10_000, 10_000, 100
ADVISE_QUERIES, ADVISE_SCANNED = 5000, 100_000


@dataclass(frozen=True)
class Estimate:
    """The estimate by fixed selectivities: at most one discriminator counts."""

    cardinality: int
    total_cost: float
    streaming: bool


def estimate(rows: int, filters: list) -> Estimate:
    n = {k: sum(isinstance(f, k) for f in filters) for k in SELECTIVITY}
    n[Discriminator] = min(n[Discriminator], 1)
    share = math.prod(SELECTIVITY[k] ** v for k, v in n.items())
    card = math.ceil(rows * share)
    cost = BASE_COST + LOOKUP * (1 + sum(n.values())) + card + n[Memcmp] * card * FILTER
    return Estimate(card, cost, card > STREAM_ROWS)


def by_selectivity(filters: list) -> list:
    """Filters by rising share of accounts that pass them, so that a conjunction tests the cheaper rejection first."""
    return sorted(filters, key=lambda f: SELECTIVITY.get(type(f), 1.0))


def column_of(f) -> str:
    """The column that a filter searches by, for the query log."""
    if isinstance(f, DataSize):
        return "data_len"
    if isinstance(f, Memcmp):
        return f"data[{f.offset}:{f.offset + len(f.bytes)}]"
    return "discriminator" if isinstance(f, Discriminator) else f.name


@dataclass
class Statistics:
    """Accounts per key of each index, as far as collected."""

    program: dict
    data_size: dict
    discriminator: dict
    memcmp: dict


@dataclass(frozen=True)
class Plan:
    order: list
    cardinalities: list[int]
    intermediate: list[int]
    cost: int


def cardinality(stats: Statistics, f) -> tuple[int, float]:
    """(accounts, confidence)."""
    if isinstance(f, DataSize):
        n = stats.data_size.get(f.size, 0)
    elif isinstance(f, Discriminator):
        n = stats.discriminator.get(f.bytes, 0)
    else:
        n = stats.memcmp.get((f.offset, f.bytes), 0)
    return n, (0.95 if isinstance(f, Discriminator) else 0.9) if n else 0.5


def plan(stats: Statistics, program, filters: list) -> Plan:
    """Filters by rising cardinality, the program among them; what remains after each; and the cost."""
    size = stats.program.get(program, UNKNOWN_PROGRAM)
    ranked = sorted([("program", size), *((f, cardinality(stats, f)[0]) for f in filters)], key=lambda x: x[1])
    counts = [n for _, n in ranked]
    # the list is sorted, so what remains is the least count from the first step on
    least = counts[0]
    joins = len(ranked) - 1
    cost = LOOKUP * len(ranked) + INTERSECT * least * joins + (FETCH * least if joins else 0)
    return Plan([x[0] for x in ranked], counts, [min(size, least)] * len(ranked), cost)


def ordered_filters(stats: Statistics, program, filters: list) -> list:
    return [f for f in plan(stats, program, filters).order if f != "program"]


def collect_statistics(accounts: DataFrame, programs: list, filters: list) -> Statistics:
    """Counts for the keys that a query names, in one pass; nothing else is collected."""
    have = set(accounts.columns)
    wanted = [F.count_if(F.col("owner") == F.lit(bytearray(p) if isinstance(p, bytes) else p)).alias(f"p{i}") for i, p in enumerate(programs)] + [F.count_if(f.column(have)).alias(f"f{i}") for i, f in enumerate(filters)]
    row = accounts.agg(*wanted).first() if wanted else {}
    of = lambda kind, key: {key(f): row[f"f{i}"] for i, f in enumerate(filters) if isinstance(f, kind)}
    return Statistics({p: row[f"p{i}"] for i, p in enumerate(programs)}, of(DataSize, lambda f: f.size), of(Discriminator, lambda f: f.bytes), of(Memcmp, lambda f: (f.offset, f.bytes)))


def advise(entries: DataFrame, key: str, slow_queries: bool = False) -> DataFrame:
    """rows, keys and the layout that suits a key column: btree (range-sorted), bitmap, hash (bloom filter) or none."""
    out = entries.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    layout = F.when(F.col("rows") < LEAST_ROWS, "none").when(F.col("keys") > BTREE_SHARE * F.col("rows"), "btree").when((F.col("keys") < BITMAP_KEYS) & (F.col("rows") > BITMAP_ROWS), "bitmap").when(F.lit(slow_queries) & (F.col("keys") > HASH_KEYS), "hash").otherwise("none")
    return out.withColumn("layout", layout)


def migrate(entries: DataFrame, key: str, layout: str, out: str, partitions: int, ids: str = "id") -> None:
    """Writes entries in a layout of advise(): range-sorted by the key, bitmaps of ids by key, with a bloom filter on the key, or as they are."""
    if layout == "btree":
        entries.repartitionByRange(partitions, key).sortWithinPartitions(key).write.parquet(out)
    elif layout == "bitmap":
        sets.to_bitmaps(entries.select(key, ids), key).write.parquet(out)
    elif layout == "hash":
        entries.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(out)
    else:
        entries.write.parquet(out)


def advise_from_log(log: DataFrame, queries: int = ADVISE_QUERIES, scanned: float = ADVISE_SCANNED) -> DataFrame:
    """Columns of a query log (column, scanned) that were asked for often and scanned widely."""
    seen = log.groupBy("column").agg(F.count("*").alias("queries"), F.avg("scanned").alias("scanned"))
    return seen.where((F.col("queries") >= queries) & (F.col("scanned") >= scanned))

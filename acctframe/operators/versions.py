"""Latest versions, layers, commitment and rollback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctframe.functions import columns as C


def latest(versions: DataFrame, key: str = "pubkey", layer: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of each key, by max_by: a task keeps one row a key before the shuffle, so a hot key's history does not meet in
    one task.  (Spark runs max_by of a struct as a sort aggregate: rows are sorted by key within tasks.)

    Order is (slot, write_version), then the layer's rank, then the columns in ties.
    """
    order = F.struct(C.version(layer=layer).alias("version"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    best = versions.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*versions.columns), order).alias("row"))
    return best.select(*[F.col("row")[c].alias(c) for c in versions.columns])


def history(versions: DataFrame, n: int, key: str = "pubkey") -> DataFrame:
    """The n newest versions of each key with their rank.  Spark keeps n rows a key in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("slot"), F.desc("write_version"))
    return versions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Slots per partition of a delta table (a fixed value).
SLOTS_PER_BUCKET = 10_000


def slot_bucket(slot: Column | int):
    return slot // SLOTS_PER_BUCKET if isinstance(slot, int) else F.floor(slot / SLOTS_PER_BUCKET)


def visible(versions: DataFrame, up_to: int) -> DataFrame:
    """Rows up to a slot; of a table that is partitioned by slot buckets only those buckets are read."""
    out = versions.where(F.col("slot") <= up_to)
    return out.where(F.col("slot_bucket") <= slot_bucket(up_to)) if "slot_bucket" in versions.columns else out


def accounts_at(layers: list[DataFrame], up_to: int, key: str = "pubkey") -> DataFrame:
    """State at a slot: each key's newest version that is visible there, over all layers."""
    union = layers[0]
    for layer in layers[1:]:
        union = union.unionByName(layer, allowMissingColumns=True)
    return latest(visible(union, up_to), key, layer="storage_type")


def merge_delta(base: DataFrame, delta: DataFrame, key: str = "pubkey") -> DataFrame:
    """accounts_at for a base that holds each key once: the delta is reduced first, then one full outer join takes the newer
    side of each key, so the base is shuffled once and never aggregated."""
    columns = list(dict.fromkeys([*base.columns, *delta.columns]))
    left = base.select(F.struct(*base.columns).alias("b"))
    right = latest(delta, key, layer="storage_type" if "storage_type" in delta.columns else None).select(F.struct(*delta.columns).alias("d"))
    both = left.join(right, F.col(f"b.{key}") == F.col(f"d.{key}"), "full_outer")
    side = lambda s, df: C.version(f"{s}.slot", f"{s}.write_version", f"{s}.storage_type" if "storage_type" in df.columns else F.lit(None).cast("string"))
    newer = F.col("d").isNotNull() & (F.col("b").isNull() | (side("d", delta) >= side("b", base)))
    field = lambda s, df, c: F.col(f"{s}.{c}") if c in df.columns else F.lit(None)
    return both.select(*[F.when(newer, field("d", delta, c)).otherwise(field("b", base, c)).alias(c) for c in columns])


def lookup(base: DataFrame, delta: DataFrame | None, keys: list[Column], up_to: int, key: str = "pubkey") -> DataFrame:
    """State at a slot of some keys: they go into both layers' scans, and only what these give is merged."""
    mine = lambda df: visible(df, up_to).where(F.col(key).isin(keys) if len(keys) != 1 else F.col(key) == keys[0])
    return mine(base) if delta is None else merge_delta(mine(base), mine(delta), key)


def matching(base: DataFrame, delta: DataFrame | None, up_to: int, match: Callable[[set[str]], Column], key: str = "pubkey") -> DataFrame:
    """State at a slot of the accounts that match.  The match goes into the base's scan; of its rows those go that the delta
    supersedes, and the newest delta rows that match come in.  The base is neither shuffled whole nor merged with keys that do not match.

    match gets the set of a layer's column names and gives the condition."""
    old = visible(base, up_to)
    if delta is None:
        return old.where(match(set(base.columns)))
    newest = latest(visible(delta, up_to), key, layer="storage_type" if "storage_type" in delta.columns else None)
    found, new = old.where(match(set(base.columns))), newest.where(match(set(delta.columns)))
    versions_of = lambda df: df.select(F.col(key).alias("__key"), F.struct("slot", "write_version").alias("__version"))
    over, under = versions_of(newest), versions_of(old)
    found = found.join(over, (found[key] == over["__key"]) & (over["__version"] >= F.struct(found["slot"], found["write_version"])), "left_anti")
    new = new.join(under, (new[key] == under["__key"]) & (under["__version"] > F.struct(new["slot"], new["write_version"])), "left_anti")
    return found.unionByName(new, allowMissingColumns=True)


def slot_range(df: DataFrame, low: int, high: int, start: str = "slot", end: str | None = None) -> DataFrame:
    """Rows whose slot, or whose slots from start to end, meet [low, high]; buckets of slots are pruned where the table has them."""
    if end is not None:
        return df.where((F.col(start) <= high) & (F.col(end) >= low))
    out = df.where(F.col(start).between(low, high))
    return out.where(F.col("slot_bucket").between(slot_bucket(low), slot_bucket(high))) if "slot_bucket" in df.columns and start == "slot" else out


def roll_back(delta: DataFrame, root: int, seq: str | None = None, up_to_seq: int | None = None) -> DataFrame:
    """delta without what came after the root; with a sequence column only rows ingested before the rollback are judged, since
    later ones may use a slot again."""
    late = F.col("slot") > root
    if seq is not None and up_to_seq is not None:
        late &= F.col(seq) <= up_to_seq
    return delta.where(~late)


def compact(base: DataFrame, delta: DataFrame, root: int, key: str = "pubkey") -> tuple[DataFrame, DataFrame]:
    """(new base, remaining delta): versions up to the root are merged into the base, later ones stay."""
    merged = merge_delta(base, visible(delta, root), key).withColumn("storage_type", F.lit("compacted"))
    return merged, delta.where(F.col("slot") > root)


def without_tombstones(df: DataFrame, lamports: str = "lamports") -> DataFrame:
    """Latest rows except closed accounts."""
    return df.where(F.col(lamports) != 0)

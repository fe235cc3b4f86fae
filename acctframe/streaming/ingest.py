"""Ingestion: an update stream becomes append-only delta files; commitment state; rollback and compaction policy."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from acctframe.operators import versions
from acctframe.operators.versions import slot_bucket

#: What makes a compaction due.
COMPACT_SEGMENTS, COMPACT_ENTRIES, COMPACT_SLOTS = 10, 100_000, 100_000
MAX_LAG = 64


#: How a delta table is laid out, whoever writes it: rows that no stream batch brought have batch -1.
LAYOUT = ("slot_bucket", "batch")


def with_layout(updates: DataFrame, batch_id: int = -1) -> DataFrame:
    return updates.drop(*LAYOUT).withColumns({"slot_bucket": slot_bucket(F.col("slot")), "batch": F.lit(batch_id)})


def append_updates(updates: DataFrame, delta: str, batch_id: int | None = None) -> None:
    """Writes a batch's newest version of each key.  A repeated batch has the same rows, so it replaces what its first attempt wrote."""
    newest = versions.latest(updates)
    if batch_id is None:
        with_layout(newest).write.mode("append").partitionBy(*LAYOUT).parquet(delta)
    else:
        with_layout(newest, batch_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(delta)


def start_ingest(updates: DataFrame, delta: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """The ingest loop: each micro-batch is reduced and appended; offsets are checkpointed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        append_updates(batch, delta, batch_id)
        if on_batch is not None:
            on_batch(batch, batch_id)

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(updates: DataFrame) -> DataFrame:
    """A running latest version per key, for update or complete mode."""
    cols = [c for c in updates.columns if c != "pubkey"]
    return updates.groupBy("pubkey").agg(F.max_by(F.struct(*cols), F.struct("slot", "write_version")).alias("row")).select("pubkey", "row.*")


def running_cardinality(updates: DataFrame, key: str) -> DataFrame:
    """A running number of updates per key, for update or complete mode."""
    return updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_updates"))


def windowed(updates: DataFrame, time: str, late: str, length: str, by: str, slide: str | None = None) -> DataFrame:
    """Updates per event-time window and key; rows later than `late` behind the newest time are left out of a stream."""
    seen = updates.withWatermark(time, late).groupBy(F.window(time, length, slide), by).agg(F.count("*").alias("n_updates"))
    return seen.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n_updates")


def drain(stream: DataFrame, out: str, mode: str = "complete") -> None:
    """Runs a stream over what is there now; each micro-batch replaces out (complete) or adds to it (append)."""
    write = lambda batch, batch_id: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_delta(spark: SparkSession, delta: str) -> DataFrame:
    return spark.read.parquet(delta)


class LagListener(StreamingQueryListener):
    """Collects the batches after which processing was more than MAX_LAG slots behind the head.

    head and processed are functions that give slots; warnings holds (query, batch, lag), the newest MOST_WARNINGS of them."""

    MOST_WARNINGS = 1000

    def __init__(self, head: Callable[[], int], processed: Callable[[], int]):
        self.head, self.processed, self.warnings = head, processed, deque(maxlen=self.MOST_WARNINGS)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        lag = self.head() - self.processed()
        if lag > MAX_LAG:
            self.warnings.append((str(event.progress.name), event.progress.batchId, lag))

    def onQueryTerminated(self, event) -> None:
        pass


@dataclass
class CommitmentState:
    """Watermarks that only rise, the root that follows the finalized slot, and rollbacks."""

    processed: int = 0
    confirmed: int = 0
    finalized: int = 0
    parent: int = 0
    root: int = 0
    rollbacks: list[dict] = field(default_factory=list)

    def update(self, level: str, slot: int) -> bool:
        if slot <= getattr(self, level):
            return False
        if level == "processed":
            self.parent = self.processed
        setattr(self, level, slot)
        if level == "finalized":
            self.root = max(self.root, slot)
        return True

    def advance(self, level: str = "processed") -> int:
        self.update(level, getattr(self, level) + 1)
        return getattr(self, level)

    def observe(self, slot: int) -> None:
        """Moves all three where only the processed slot is known: one slot behind, and thirty-one."""
        self.update("processed", slot)
        self.update("confirmed", slot - 1 if slot > 1 else 0)
        self.update("finalized", slot - 31 if slot > 31 else 0)

    def watermark(self, level: str) -> int:
        return {"processed": self.processed, "confirmed": self.confirmed, "finalized": self.finalized}[level]

    def is_visible(self, slot: int, level: str) -> bool:
        return slot <= self.watermark(level)

    def update_root(self, slot: int) -> int:
        old, self.root = self.root, slot
        return old

    def roll_back(self, root: int, seq: int | None = None) -> None:
        """The root becomes `root` and the finalized slot is no higher; the other levels stay."""
        self.rollbacks.append({"from": self.root, "to": root, "seq": seq})
        self.root = root
        self.finalized = min(self.finalized, root)

    def lagging(self, head: int) -> bool:
        return head - self.processed > MAX_LAG

    def visible_delta(self, delta: DataFrame, seq: str | None = None) -> DataFrame:
        for r in self.rollbacks:
            delta = versions.roll_back(delta, r["to"], seq, r["seq"])
        return delta

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, text: str) -> CommitmentState:
        return cls(**json.loads(text))


def compaction_due(segments: int, entries: int, slots_since: int = 0) -> bool:
    return segments >= COMPACT_SEGMENTS or entries >= COMPACT_ENTRIES or slots_since >= COMPACT_SLOTS


def compact_to(spark: SparkSession, base: str, delta: str, new_base: str, new_delta: str, root: int, partitions: int) -> int:
    """Merges delta up to the root into a new base and keeps the later rows as the new delta, in the layout that ingestion goes on
    with; callers delete the inputs once they have switched to both outputs.  Returns 1, the number of compactions."""
    merged, rest = versions.compact(spark.read.parquet(base), read_delta(spark, delta), root)
    merged.drop(*LAYOUT).repartitionByRange(partitions, "pubkey").sortWithinPartitions("pubkey").write.parquet(new_base)
    with_layout(rest).write.partitionBy(*LAYOUT).parquet(new_delta)
    return 1


def state_table(state: CommitmentState, spark: SparkSession) -> DataFrame:
    """The state as one row, for a table that keeps its history."""
    fields = ("processed", "confirmed", "finalized", "parent", "root")
    return spark.range(1, numPartitions=1).select(*[F.lit(getattr(state, f)).cast("long").alias(f) for f in fields])


@dataclass
class PostingLayers:
    """When a table of postings with deltas is due for compaction (fixed thresholds)."""

    deltas: int = 0
    last_delta_rows: int = 0
    inserts: int = 0

    def due(self) -> bool:
        return self.deltas >= 4 or self.last_delta_rows >= 100_000 or self.inserts >= 1_000_000

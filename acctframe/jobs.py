"""Command-line jobs: python -m acctframe.jobs bootstrap | ingest | compact | stats."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from acctframe.sources import records, segments
from acctframe.streaming import ingest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="acctframe.jobs", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("bootstrap", help="base files to a Parquet base")
    p.add_argument("files")
    p.add_argument("base")
    p.add_argument("--partitions", type=int, default=200)
    p.add_argument("--header", choices=("auto", "true", "false"), default="false")
    p = jobs.add_parser("ingest", help="delta segments to the delta table, each once")
    p.add_argument("segments")
    p.add_argument("delta")
    p.add_argument("checkpoint")
    p = jobs.add_parser("compact", help="base and delta up to a root to a new base and the rest of the delta")
    for name in ("base", "delta", "new_base", "new_delta"):
        p.add_argument(name)
    p.add_argument("--root", type=int, required=True)
    p.add_argument("--partitions", type=int, default=200)
    p = jobs.add_parser("stats", help="files, accounts and bytes of base files")
    p.add_argument("files")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName(f"acctframe-{a.job}").getOrCreate()
    if a.job == "bootstrap":
        records.bootstrap(spark, a.files, a.base, a.partitions, a.header)
    elif a.job == "ingest":
        spark.dataSource.register(segments.SegmentSource)
        ingest.start_ingest(spark.readStream.format("delta_segment").load(a.segments), a.delta, a.checkpoint, once=True).awaitTermination()
    elif a.job == "compact":
        ingest.compact_to(spark, a.base, a.delta, a.new_base, a.new_delta, a.root, a.partitions)
    else:
        records.scan_stats(records.scan(spark, a.files)).show()


if __name__ == "__main__":
    main()

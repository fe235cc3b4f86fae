"""Table reading and hand-over of intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctframe.shared import delete_path, drop_stored, exists, fresh, new_path, stored

__all__ = ["delete_path", "drop_stored", "exists", "fresh", "new_path", "release", "size_of", "stored", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished jobs before the next large shuffle starts.

    The session holds on to the job that ran last, so a job of one row runs first."""
    import gc

    spark.range(1, numPartitions=1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (column text)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]


def size_of(df: DataFrame) -> int:
    """Bytes of the files below df (what the optimizer knows without a job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

"""The folder that driver and executors share, and tables handed over through it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A session in one process (tests, single-machine runs) may leave it unset and gets a local folder; a
    cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/acctframe-shared"
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/acctframe/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Writes df once to the shared folder and returns a reader of it: later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored() table once nothing will read it again."""
    delete_path(df.sparkSession, df.__dict__["_stored_at"])


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    fs, at = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def fresh(docs: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column of docs has (told apart as Spark does, without case)."""
    taken, out, k = {c.lower() for c in docs.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out

"""Intermediate tables in the folder that driver and executors share.

A cut writes a DataFrame there and reads it back: the lineage ends, and lost executors cost a rerun of their tasks and
nothing else. The shuffle files of a cut's job go when it ends. A table goes when its readers are done and say so
(`drop`), and what is left goes when the driver's JVM exits.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on this machine alone gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        there = context._jsc.sc().getCheckpointDir()
        if there.isDefined():
            base = there.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            base = "file://" + tempfile.mkdtemp(prefix="rodada-checkpoint-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A name in the shared folder that nobody uses."""
    return f"{shared_folder(spark)}/rodada-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def forget_on_exit(spark: SparkSession, path: str) -> None:
    """Delete what is at path when the driver's JVM exits."""
    where, at = _file_system(spark, path)
    where.deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path, before = fresh_path(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    forget_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames that cut() returned, which nothing reads any more."""
    for df in frames:
        where, at = _file_system(df.sparkSession, df._cut_path)
        where.delete(at, True)


def free(spark: SparkSession) -> None:
    """Let the driver's JVM give back what finished plans held: heap, broadcasts and generated classes.

    Left alone, its collector lets the heap grow where many short jobs follow each other, though little of it is in use.
    """
    spark.sparkContext._jvm.System.gc()

"""Raw documents: a read-through cache in front of mirrors that may fail, and publishing finished files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    where, at = _place(spark, path)
    return where.exists(at)


def read_document(spark: SparkSession, path: str) -> str:
    """The text of one small document."""
    return "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    where, at = _place(spark, path)
    return [x.getPath().getName() for x in where.listStatus(at)]


def delete(spark: SparkSession, path: str) -> None:
    where, at = _place(spark, path)
    where.delete(at, True)


def first_answer(mirrors: Sequence[str], fetch: Callable[[str], str], attempts: int = 2, pause_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first mirror's answer: each is tried `attempts` times, with a longer pause after each failure."""
    last: Exception | None = None
    for mirror in mirrors:
        for attempt in range(1, attempts + 1):
            try:
                return fetch(mirror)
            except Exception as error:  # any failure of a mirror leads to the next try
                last = error
                sleep(pause_s * attempt)
    raise ConnectionError(f"no mirror of {len(mirrors)} answered") from last


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """One document, written beside its place and renamed, so that readers see the old or the new one."""
    where, at = _place(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = where.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    where.delete(at, False)
    if not where.rename(beside, at):
        raise OSError(f"can't put {path} in place")


def place_text(document: DataFrame, path: str) -> None:
    """A frame of one row of text as one file at path: written beside it by a task and renamed, so a failure leaves the old file."""
    spark, beside = document.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        document.coalesce(1).write.text(beside)
        where, at = _place(spark, path)
        part = next(n for n in folders(spark, beside) if n.startswith("part-"))
        where.delete(at, False)
        if not where.rename(_place(spark, f"{beside}/{part}")[1], at):
            raise OSError(f"can't put {path} in place")
    finally:
        delete(spark, beside)


def read_through(spark: SparkSession, path: str, mirrors: Sequence[str], fetch: Callable[[str], str], read: Callable[[SparkSession, str], DataFrame], refresh: bool = False, **retry) -> DataFrame:
    """read(path), fetched and written there first if it isn't there or refresh asks for it."""
    if refresh or not exists(spark, path):
        write_document(spark, first_answer(mirrors, fetch, **retry), path)
    return read(spark, path)


def publish(spark: SparkSession, source: str, target: str, names: Sequence[str]) -> list[str]:
    """Copy those of the named files or folders that are there from source to target; returns their names."""
    jvm, conf, done = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in names:
        if exists(spark, f"{source}/{name}"):
            (a, a_at), (b, b_at) = _place(spark, f"{source}/{name}"), _place(spark, f"{target}/{name}")
            beside = _place(spark, f"{target}/{name}.{uuid.uuid4().hex}.tmp")[1]
            jvm.org.apache.hadoop.fs.FileUtil.copy(a, a_at, b, beside, False, True, conf)
            b.delete(b_at, True)  # what was there goes once the new copy is whole
            if not b.rename(beside, b_at):
                raise OSError(f"can't put {target}/{name} in place")
            done.append(name)
    return done

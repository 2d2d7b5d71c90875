"""Shared plumbing of the training-data operators: tables, objects that workers keep, row access, samples."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple, object] = {}


def kept(make: Callable, *settings):
    """make(*settings), kept by the worker process: Spark gives a process many tasks, which then find caches warm.

    Nothing that a task computes depends on what an earlier one left; only `make`'s bounded caches stay. One object is
    kept, so that a pipeline's next stage doesn't pay for the last one's; a stage that keeps nothing calls release().
    """
    key = (make, *settings)
    if key not in _KEPT:
        release()
        _KEPT[key] = make(*settings)
    return _KEPT[key]


def release() -> None:
    """Give up what kept() holds in this worker; its caches hold each other in circles, which only a collection frees."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


def texts(batch: pa.RecordBatch, column: str, slice_rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in small slices with one column as Python objects, so that few copies of long texts live at once."""
    for at in range(0, batch.num_rows, slice_rows):
        part = batch.slice(at, slice_rows)
        yield part, part.column(column).to_pylist()


def n_rows_at_most(df: DataFrame, bound: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """A deterministic sample of about `bound` rows at most: rows whose key hashes below bound/count."""
    n = df.count()
    if n <= bound:
        return df
    buckets = 1_000_000_007
    keep = int(buckets * bound / n)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)) < keep)

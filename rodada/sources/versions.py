"""Tables that are replaced as a whole: each version in a folder of its own, and a manifest that names the current one.

A merge writes a new version beside the old one and then puts the manifest in place by a rename. Readers see the old
rows or the new ones, a merge that fails leaves the old ones, and what a running reader has open stays until `vacuum`.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rodada.sources.raw import delete, exists, folders, read_document, write_document

_CURRENT = "CURRENT"


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the current version; None if there never was one."""
    if not exists(spark, f"{path}/{_CURRENT}"):
        return None
    return spark.read.parquet(f"{path}/{read_document(spark, f'{path}/{_CURRENT}').strip()}")


def replace(rows: DataFrame, path: str) -> str:
    """Make rows the current version; returns its name."""
    name = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    write_document(rows.sparkSession, name, f"{path}/{_CURRENT}")
    return name


def merge(rows: DataFrame, path: str, keys: Sequence[str], latest: str | None = None) -> str:
    """A new version with rows in the place of those of the same keys, and all others as they were.

    Of rows that share their keys the one with the largest `latest` stays (any, if it isn't given); null keys are equal.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*([F.desc(latest)] if latest else [F.lit(0)])))
    new = rows.withColumn("_n", first).filter("_n = 1").drop("_n")
    old = current(rows.sparkSession, path)
    if old is not None:
        there, here = old.alias("there"), new.select(*keys).alias("here")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"there.{k}").eqNullSafe(F.col(f"here.{k}"))
        new = there.join(here, same, "left_anti").unionByName(new, allowMissingColumns=True)
    return replace(new, path)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions but the current one, when no reader is left; returns their names."""
    if not exists(spark, f"{path}/{_CURRENT}"):
        return []
    keep = read_document(spark, f"{path}/{_CURRENT}").strip()
    gone = sorted(x for x in folders(spark, path) if x.startswith("v-") and x != keep)
    for name in gone:
        delete(spark, f"{path}/{name}")
    return gone

"""Many cities as one graph: node ids that tell their city, so that one plan serves all cities.

A stacked id is the city's number, then the id in 40 bits. Ids keep their order within a city, which decides ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rodada.functions.geo import cos_latitude
from rodada.operators.graph import ranked
from rodada.operators.work import cut

ID_BITS = 40


def stacked_id(number: Column, node: Column) -> Column:
    return F.shiftleft(number.cast("long"), ID_BITS).bitwiseOR(node)


def own_id(node: Column) -> Column:
    """The id in its city."""
    return node.bitwiseAND(F.lit((1 << ID_BITS) - 1))


def city_numbers(nodes: DataFrame) -> DataFrame:
    """(city, number, cos_lat) of nodes (city, id, lon, lat): numbers in the order of names, the scale of each city's middle."""
    cities = nodes.groupBy("city").agg(F.min("id").alias("low"), F.max("id").alias("high"), cos_latitude(F.min("lat"), F.max("lat")).alias("cos_lat"))
    cities = cut(ranked(cities, ["city"], "number"))
    ends = cities.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    if ends["low"] is not None and (ends["low"] < 0 or ends["high"] >= 1 << ID_BITS):
        raise ValueError(f"ids of nodes must be from 0 to 2^{ID_BITS} - 1")
    return cities.select("city", "number", "cos_lat")


def stacked(numbers: DataFrame, rows: DataFrame, *ids: str) -> DataFrame:
    """rows (city, ...) with the scale of their city and stacked ids; rows of unknown cities are left out."""
    known = rows.join(numbers, "city")
    return known.withColumns({c: stacked_id(F.col("number"), F.col(c)) for c in ids}).drop("number")


def stacked_graphs(spark: SparkSession, tables: str, cities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(numbers, nodes, edges) of those of cities (city) that have a graph in tables partitioned by city; others' files aren't read."""
    try:
        nodes, edges = (spark.read.parquet(f"{tables}/{x}").withColumnRenamed("city_id", "city") for x in ("nodes", "edges"))
    except AnalysisException:
        return None
    asked = cities.select(F.col("city").cast("string")).distinct()
    nodes, edges = (x.withColumn("city", F.col("city").cast("string")).join(asked, "city", "left_semi") for x in (nodes, edges))
    numbers = city_numbers(nodes)
    return numbers, stacked(numbers, nodes, "id"), stacked(numbers, edges, "u", "v").drop("cos_lat")


def unstacked(rows: DataFrame, ids: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> DataFrame:
    """rows with the ids that nodes have in their city, in columns and in paths (columns, or fields as column.field)."""
    changed = {c: own_id(F.col(c)) for c in ids}
    for name in paths:
        column, _, field = name.partition(".")
        own = F.transform(F.col(name), own_id)
        changed[column] = F.when(F.col(column).isNotNull(), F.col(column).withField(field, own)) if field else own
    return reduce(lambda df, x: df.withColumn(*x), changed.items(), rows)

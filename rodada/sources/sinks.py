"""Sinks: GeoJSON feature collections, graph documents and Parquet tables partitioned by city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rodada.sources.raw import place_text


def line_features(rows: DataFrame, coords: str = "coordinates", id_col: str = "id", order: str | None = None) -> DataFrame:
    """One JSON text per row: a LineString feature whose properties are the other columns; with the column to order by, if given."""
    properties = F.struct(*(c for c in rows.columns if c != coords))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(id_col).cast("string").alias("id"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col(coords).alias("coordinates")).alias("geometry"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"), *([F.col(order).alias("_order")] if order else []))


def write_features(rows: DataFrame, path: str, **kwargs) -> None:
    """Newline-delimited features: written in parallel, whatever the number."""
    line_features(rows, **kwargs).write.mode("overwrite").text(path)


def collection(features: DataFrame, name: str, metadata: Column | DataFrame, order: str | None = None) -> DataFrame:
    """One row with a whole FeatureCollection, for layers of bounded size (a city's gaps or phases).

    metadata is a constant, or a frame of one row whose columns become its fields.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order) if order else F.lit(0), F.col("feature"))))
    title, made = F.to_json(F.array(F.lit(name))), features.agg(items.alias("f"))
    if isinstance(metadata, DataFrame):
        made, metadata = made.crossJoin(metadata.select(F.struct(*metadata.columns).alias("m"))), F.col("m")  # one row each
    crs = '"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}'
    head = F.concat(F.lit('{"type":"FeatureCollection","name":'), title.substr(F.lit(2), F.length(title) - 2), F.lit(f',{crs},"metadata":'), F.to_json(metadata), F.lit(',"features":['))
    return made.select(F.concat(head, F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("document"))


def write_collection(rows: DataFrame, path: str, name: str, metadata: Column | DataFrame, order: str) -> None:
    """The rows' features, in the order of a column, as one GeoJSON document at path; the old one stays until it is whole."""
    place_text(collection(line_features(rows, order=order), name, metadata, "_order"), path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, city: str) -> None:
    """Nodes and edges as Parquet tables partitioned by city; a city's partition is replaced."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("city_id", F.lit(city)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city_id").parquet(f"{path}/{name}")


def graph_document(nodes: DataFrame, edges: DataFrame, city: str) -> DataFrame:
    """One row with a graph document, for one city: bounded."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "lon", "lat"))).alias("nodes"))
    e = edges.drop("surface", "maxspeed").agg(F.array_sort(F.collect_list(F.struct("u", "v", *(c for c in edges.columns if c not in ("u", "v", "surface", "maxspeed"))))).alias("edges"))
    stats = F.struct(F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(city).alias("city"), stats.alias("stats"), "nodes", "edges")).alias("document"))

"""Catalogue queries: cities, their layers, and layer documents, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layers that a city can have.
LAYERS = (("cycling-infrastructure", "Infraestructura ciclista", "line"), ("suggested-routes", "Rutas sugeridas", "line"), ("missing-connections", "Conexiones faltantes", "line"), ("network-expansion", "Expansión de red", "line"))


def layer_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAYERS), "id string, name string, type string")


def cities(registry: DataFrame, details: DataFrame) -> DataFrame:
    """Registry rows with what the city documents (id, description, stats, connectivity) add or replace."""
    d = details.select("id", F.col("description").alias("_description"), "stats", "connectivity")
    own = F.col("description") if "description" in registry.columns else F.lit(None).cast("string")
    return registry.join(d, "id", "left").withColumn("description", F.coalesce(F.nullif("_description", F.lit("")), own)).drop("_description")


def city(registry: DataFrame, details: DataFrame, city_id: str) -> DataFrame:
    """The city's row; no row if there is none."""
    return cities(registry, details).filter(F.col("id") == city_id)


def with_files(layers: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """Those layers that have a file."""
    return layers.join(files.select(*on), on, "left_semi")


def available_layers(spark: SparkSession, files: DataFrame, city_id: str) -> DataFrame:
    """Definitions of the layers whose file (city, layer, feature_count) is there, with the number of features."""
    mine = files.filter(F.col("city") == city_id).select(F.col("layer").alias("id"), "feature_count")
    return with_files(layer_definitions(spark), mine, ["id"]).join(mine, "id")


def layer(files: DataFrame, city_id: str, layer_id: str) -> DataFrame:
    """Features (JSON texts) of one layer."""
    return files.filter((F.col("city") == city_id) & (F.col("layer") == layer_id)).select(F.explode("features").alias("feature"))


def enabled_cities(registry: DataFrame) -> DataFrame:
    return registry.filter(F.coalesce("enabled", F.lit(False)))


def od_pairs(registry: DataFrame, most: int = 5) -> DataFrame:
    """(city, id, name, description, origin_name, dest_name, origin, destination): representative routes, or else each of the next presets with the first one."""
    own = registry.filter(F.size("representative_routes") > 0).select(F.col("id").alias("city"), F.explode("representative_routes").alias("r"))
    own = own.select("city", "r.id", "r.name", "r.description", "r.origin_name", "r.dest_name", F.col("r.origin_coord").alias("origin"), F.col("r.dest_coord").alias("destination"))
    rest = registry.filter(F.coalesce(F.size("representative_routes"), F.lit(0)) <= 0).filter(F.size("presets") > 1)
    made = rest.select(F.col("id").alias("city"), F.get("presets", 0).alias("c"), F.posexplode(F.slice("presets", 2, most)).alias("pos", "p"))
    number, other = F.format_string("%02d", F.col("pos") + 1), F.col("p.name")
    made = made.select(
        "city", F.concat(F.lit("route-"), "city", F.lit("-"), number).alias("id"), F.concat(F.lit("Ruta #"), number, F.lit(": "), other, F.lit(" → "), F.col("c.name")).alias("name"),
        F.concat(F.lit("Conexión desde "), other, F.lit(" hacia el centro cívico.")).alias("description"), other.alias("origin_name"), F.col("c.name").alias("dest_name"), F.col("p.coord").alias("origin"), F.col("c.coord").alias("destination"),
    )
    return own.unionByName(made)


def first_available(*sources: DataFrame) -> DataFrame:
    """The first of the sources that has a row, all by one plan; the last one if none has."""
    there = [s.limit(1).agg((F.count("*") > 0).alias("_any")).select(F.lit(k).alias("_source"), "_any") for k, s in enumerate(sources)]
    first = reduce(DataFrame.unionByName, there).filter(F.col("_any")).agg(F.min("_source").alias("_first"))  # one row
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)])
    return tagged.join(F.broadcast(first), F.col("_source") == F.col("_first")).drop("_source", "_first")

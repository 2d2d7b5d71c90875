"""Sources: OpenStreetMap-style JSON documents, city registries, layers and catalogues, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodada.functions.tags import HIGHWAY_PENALTY

ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,nodes:array<bigint>,tags:map<string,string>>>"
CITY = "id string, name string, province string, region string, country string, enabled boolean, center array<double>, bounds array<array<double>>, bbox array<double>, initial_zoom double, presets array<struct<id:string,name:string,coord:array<double>>>, representative_routes array<struct<id:string,name:string,description:string,origin_name:string,dest_name:string,origin_coord:array<double>,dest_coord:array<double>>>, description string"
#: Roads that bicycles may use: the kinds with a known penalty but motorways. A prefix match, so link roads follow.
ROADS = "^(" + "|".join(dict.fromkeys(k.removesuffix("_link") for k in HIGHWAY_PENALTY if not k.startswith("motorway"))) + ")"
#: What the place scan takes.
NODE_PLACES = {
    "amenity": r"^(school|college|university|hospital|clinic|doctors|pharmacy|police|fire_station|post_office|townhall|courthouse|community_centre|marketplace|bus_station)",
    "leisure": r"^(park|pitch|sports_centre|playground)",
    "shop": r"^(supermarket|mall|department_store)",
    "railway": r"^(station|halt)",
}
WAY_PLACES = {
    "amenity": r"^(school|college|university|hospital|clinic|townhall|community_centre|marketplace)",
    "leisure": r"^(park|pitch|sports_centre)",
    "shop": r"^(supermarket|mall)",
}


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All elements of documents, with pos (place in the document) and file."""
    doc = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    return doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("elements").alias("pos", "e")).select("file", "pos", "e.*")


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes id, lon, lat to six decimals; ways pos, id, nodes, tags); of a repeated node id the last wins."""
    nodes = elements.filter("type = 'node'").groupBy("id").agg(F.max_by(F.struct(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), F.struct("file", "pos")).alias("c"))
    empty = F.expr("cast(map() as map<string,string>)")
    ways = elements.filter("type = 'way'").select("file", "pos", "id", F.coalesce("nodes", F.expr("cast(array() as array<bigint>)")).alias("nodes"), F.coalesce("tags", empty).alias("tags"))
    return nodes.select("id", "c.*"), ways


def _matches(rules: dict[str, str]) -> F.Column:
    out = F.lit(False)
    for key, pattern in rules.items():
        out = out | F.coalesce(F.col("tags")[key].rlike(pattern), F.lit(False))
    return out


def cycleway_scan(elements: DataFrame) -> DataFrame:
    """Ways with cycling infrastructure tags, and the nodes."""
    t = F.col("tags")
    has = (t["highway"] == "cycleway") | F.exists(F.map_keys(t), lambda k: k.startswith("cycleway")) | (t["bicycle"] == "designated")
    return elements.filter((F.col("type") == "node") | F.coalesce(has, F.lit(False)))


def road_scan(elements: DataFrame) -> DataFrame:
    """Ways on cyclable kinds of roads, and the nodes."""
    return elements.filter((F.col("type") == "node") | F.coalesce(F.col("tags")["highway"].rlike(ROADS), F.lit(False)))


def place_scan(elements: DataFrame) -> DataFrame:
    """Nodes and ways that are places of interest."""
    return elements.filter(((F.col("type") == "node") & _matches(NODE_PLACES)) | ((F.col("type") == "way") & _matches(WAY_PLACES)))


def in_box(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows inside a bounding box; the bounds reach a Parquet scan."""
    return df.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per city of the registry document."""
    return spark.read.schema(f"version string, cities array<struct<{CITY.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline("cities"))


def read_city_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per city document (.../<city>/city.json) by path, for folders without a registry; malformed ones are left out."""
    doc = spark.read.schema(f"{CITY}, stats map<string,string>, connectivity map<string,string>").option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return doc.filter("id is not null").withColumn("file", F.col("_metadata.file_path")).orderBy("file")


def read_layers(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, city, layer, feature_count, features as JSON) of GeoJSON documents under .../<city>/<layer>.geojson."""
    doc = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("file"), "value")
    features = F.from_json("value", "features array<string>")["features"]
    return doc.select("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("city"), F.regexp_extract("file", r"([^/]+)\.geojson$", 1).alias("layer"), F.coalesce(F.size(features), F.lit(0)).alias("feature_count"), features.alias("features"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a serialised graph document; a path without one is an error of Spark's reader."""
    edge = "u:bigint,v:bigint,length_m:double,cost:double,penalty_factor:double,way_id:bigint,name:string,highway:string,category:string,infra_label:string,is_cycling_infra:boolean"
    doc = spark.read.schema(f"nodes array<struct<id:bigint,lon:double,lat:double>>, edges array<struct<{edge}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))

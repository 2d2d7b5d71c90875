"""A road network derived from the driver's tables, by arithmetic that Spark and DuckDB do alike.

Each fixture is one SQL text that both engines run: nodes on a lattice of about 100 m, ways from orders and their
line numbers (with gaps and missing nodes), tags from order keys, places of interest, and route requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COS_LAT = 0.8192  # of the lattice's latitude, fixed so that both engines use one number

NODE = """SELECT p_partkey AS id, round(-71.26e0 + 0.0011e0 * (p_partkey % 50), 6) AS lon,
 round(-34.99e0 + 0.0009e0 * CAST((p_partkey - p_partkey % 50) / 50 AS BIGINT), 6) AS lat FROM part"""

POSITION = """SELECT way_id, pos, CASE WHEN step = 1 AND (node - node % 50) <> (base - base % 50) THEN -1 ELSE node END AS node
 FROM (SELECT o AS way_id, k AS pos, base, step, base + step * (k - 1) AS node
 FROM (SELECT o, k, (o * 7919) % n AS base, CASE WHEN o % 2 = 0 THEN 1 ELSE 50 END AS step
 FROM (SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS k FROM lineitem) d CROSS JOIN (SELECT count(*) AS n FROM part) c) b) p"""

WAY = """SELECT o_orderkey AS way_id, CASE WHEN o_orderkey % 97 = 0 THEN 'cycleway' WHEN o_orderkey % 103 = 0 THEN 'motorway'
 WHEN o_orderpriority = '1-URGENT' THEN 'primary' WHEN o_orderpriority = '2-HIGH' THEN 'secondary' WHEN o_orderpriority = '3-MEDIUM' THEN 'tertiary'
 WHEN o_orderpriority = '5-LOW' THEN 'service' WHEN o_orderkey % 17 = 0 THEN 'track' ELSE 'residential' END AS highway,
 CASE WHEN o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 THEN 'yes' END AS segregated,
 CASE WHEN o_orderkey % 89 = 0 THEN 'lane' WHEN o_orderkey % 83 = 0 THEN 'opposite_lane' END AS cycleway,
 CASE WHEN o_orderkey % 79 = 0 THEN 'track' END AS cycleway_right,
 CASE WHEN o_orderkey % 11 = 0 THEN 'yes' WHEN o_orderkey % 53 = 0 THEN '-1' END AS oneway,
 CASE WHEN o_orderkey % 55 = 0 THEN 'no' END AS oneway_bicycle,
 CASE WHEN o_orderkey % 7 = 0 THEN '30' WHEN o_orderkey % 7 = 1 THEN '50 km/h' WHEN o_orderkey % 7 = 2 THEN '60' WHEN o_orderkey % 7 = 3 THEN '50;60' WHEN o_orderkey % 7 = 4 THEN 'walk' END AS maxspeed,
 CASE WHEN o_orderkey % 5 = 0 THEN '4' WHEN o_orderkey % 5 = 1 THEN '3' WHEN o_orderkey % 5 = 2 THEN '2' END AS lanes,
 CASE WHEN o_orderkey % 13 = 0 THEN 'gravel' WHEN o_orderkey % 13 = 1 THEN 'asphalt' END AS surface,
 CASE WHEN o_orderkey % 101 = 0 THEN 'private' END AS access, CASE WHEN o_orderkey % 71 = 0 THEN 'designated' WHEN o_orderkey % 73 = 0 THEN 'no' END AS bicycle,
 CASE WHEN o_orderkey % 19 <> 0 THEN concat('Calle ', CAST(o_orderkey % 37 AS VARCHAR(20))) END AS name FROM orders"""

POI = """SELECT id, name, category, round(-71.26e0 + 0.0011e0 * (id * 31 % 50) + 0.00003e0 * (id % 7), 6) AS lon, round(-34.99e0 + 0.0009e0 * (id * 17 % 40) + 0.00002e0 * (id % 5), 6) AS lat
 FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'Sin nombre' ELSE concat('Plaza ', CAST(c_custkey % 23 AS VARCHAR(20))) END AS name,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'education' WHEN c_mktsegment = 'MACHINERY' THEN 'healthcare' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'commercial' ELSE 'other' END AS category FROM customer) c"""

REQUEST = """SELECT event_id AS seq, round(-71.26e0 + 0.0011e0 * (user_id % 50) + 0.0002e0, 6) AS o_lon, round(-34.99e0 + 0.0009e0 * (user_id % 4), 6) AS o_lat,
 round(-71.26e0 + 0.0011e0 * (event_id % 50), 6) AS d_lon, round(-34.99e0 + 0.0009e0 * (event_id % 3), 6) AS d_lat, CASE WHEN event_id % 6 = 0 THEN 'direct' ELSE 'balanced' END AS profile FROM events"""

TABLES = {"node": ("part",), "position": ("lineitem", "part"), "way": ("orders",), "poi": ("customer",), "request": ("events",)}
SQL = {"node": NODE, "position": POSITION, "way": WAY, "poi": POI, "request": REQUEST}
TAG_COLUMNS = {
    "highway": "highway", "segregated": "segregated", "cycleway": "cycleway", "cycleway:right": "cycleway_right", "oneway": "oneway", "oneway:bicycle": "oneway_bicycle",
    "maxspeed": "maxspeed", "lanes": "lanes", "surface": "surface", "access": "access", "bicycle": "bicycle", "name": "name",
}


def ctes(*names: str) -> str:
    """The fixtures as g_<name> common table expressions, for oracle SQL."""
    return ", ".join(f"g_{n} AS ({SQL[n]})" for n in names)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture as a DataFrame."""
    text = SQL[name]
    for t in TABLES[name]:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, tags) with the tag columns as a map."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in TAG_COLUMNS.items()))
    return fixture(spark, sf_dir, "way").select("way_id", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))

"""Sources, sinks, catalogue, planning and streaming on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from rodada.operators.expansion import coverage, plan_expansion
from rodada.plans import catalog
from rodada.plans.build import build_city, cycleway_layer
from rodada.sources import osm, sinks
from rodada.streaming.requests import first_requests

DOC = {
    "elements": [
        {"type": "node", "id": 1, "lat": -34.98, "lon": -71.24},
        {"type": "node", "id": 2, "lat": -34.981, "lon": -71.2410000004},
        {"type": "node", "id": 2, "lat": -34.981, "lon": -71.241},
        {"type": "node", "id": 3, "lat": -34.982, "lon": -71.242, "tags": {"amenity": "school", "name": "Escuela"}},
        {"type": "way", "id": 100, "nodes": [1, 2], "tags": {"highway": "cycleway"}},
        {"type": "way", "id": 200, "nodes": [2, 3], "tags": {"highway": "residential", "name": "Norte", "surface": "asphalt", "segregated": "yes", "bicycle": "designated"}},
        {"type": "way", "id": 300, "nodes": [3, 9], "tags": {"highway": "motorway"}},
        {"type": "way", "id": 400, "center": {"lat": -34.99, "lon": -71.25}, "tags": {"leisure": "park"}},
        {"type": "way", "id": 500},
    ]
}


@pytest.fixture
def elements(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(DOC, indent=1))
    return osm.read_elements(spark, str(tmp_path / "e.json"))


def test_demux_and_scans(elements):
    nodes, ways = osm.split_elements(elements)
    assert sorted((r["id"], r["lon"]) for r in nodes.collect()) == [(1, -71.24), (2, -71.241), (3, -71.242)]
    assert {r["id"]: (r["nodes"], r["tags"]) for r in ways.collect()}[500] == ([], {})
    ids = lambda df: sorted(r["id"] for r in df.filter("type = 'way'").collect())
    assert ids(osm.cycleway_scan(elements)) == [100, 200] and ids(osm.road_scan(elements)) == [100, 200] and ids(osm.place_scan(elements)) == [400]
    assert osm.in_box(nodes, -34.9805, -72, -34, -71).count() == 1


def test_layer_document(spark, elements, tmp_path):
    rows = cycleway_layer(elements, "x").orderBy("id").collect()
    assert [r["id"] for r in rows] == ["x-osm-100", "x-osm-200"] and rows[0]["surface"] is None and rows[1]["surface"] == "asphalt" and rows[1]["length_m"] > 0
    features = sinks.line_features(cycleway_layer(elements, "x"))
    text = sinks.collection(features, "Vías \"x\"", F.struct(F.lit("x").alias("city"))).first()["document"]
    doc = json.loads(text)
    assert doc["name"] == 'Vías "x"' and len(doc["features"]) == 2 and doc["features"][0]["geometry"]["type"] == "LineString" and doc["features"][0]["properties"]["surface"] is None
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "cycling-infrastructure.geojson").write_text(text)
    (tmp_path / "x" / "bad.geojson").write_text("{not json")
    files = osm.read_layers(spark, str(tmp_path / "x" / "*.geojson"))
    got = catalog.available_layers(spark, files, "x").collect()
    assert [(r["id"], r["feature_count"]) for r in got] == [("cycling-infrastructure", 2)]
    assert catalog.layer(files, "x", "cycling-infrastructure").count() == 2 and catalog.layer(files, "x", "no").count() == 0


def test_registry_and_cities(spark, tmp_path):
    doc = {"version": "1", "cities": [{"id": "a", "name": "A", "enabled": True, "presets": [{"id": str(i), "name": "p", "coord": [float(i), 0.0]} for i in range(8)], "representative_routes": []}, {"id": "b", "name": "B", "enabled": False, "presets": [], "representative_routes": [{"id": "r", "name": "R", "origin_coord": [1.0, 2.0], "dest_coord": [3.0, 4.0]}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    reg = osm.read_registry(spark, str(tmp_path / "r.json"))
    details = spark.createDataFrame([("a", "", {"km": 1.0}, {"n": 1.0})], "id string, description string, stats map<string,double>, connectivity map<string,double>")
    got = {r["id"]: r for r in catalog.cities(reg, details).collect()}
    assert got["a"]["stats"] == {"km": 1.0} and got["b"]["stats"] is None and catalog.city(reg, details, "zz").count() == 0
    pairs = catalog.od_pairs(reg).collect()
    assert len(pairs) == 6 and [r["destination"] for r in pairs if r["city"] == "b"] == [[3.0, 4.0]]
    assert catalog.first_available(reg.limit(0), reg).count() == 2


def test_graph_document(spark, tmp_path):
    n = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.1, 1.0)], "id long, lon double, lat double")
    e = spark.createDataFrame([(1, 2, 5.0, "a")], "u long, v long, length_m double, surface string")
    text = sinks.graph_document(n, e, "x").first()["document"]
    (tmp_path / "g.json").write_text(text)
    nodes, edges = osm.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.first()["length_m"] == 5.0 and json.loads(text)["stats"] == {"node_count": 2, "edge_count": 1}
    sinks.write_graph(n, e, str(tmp_path / "t"), "x")
    assert spark.read.parquet(str(tmp_path / "t" / "edges")).filter("city_id = 'x'").count() == 1


def test_build_city(spark, elements, tmp_path):
    out = build_city(spark, "x", str(tmp_path / "e.json"), str(tmp_path / "out"), 0.82, 2)
    assert out["cycleways"] == 2 and out["nodes"] == 3 and out["components"] == 1 and out["places"] == 2
    assert spark.read.text(str(tmp_path / "out" / "x" / "cycling-infrastructure")).count() == 2


def test_plan_expansion(spark):
    """A cycling street along the south of a lattice: corridors must start on it and reach the uncovered north."""
    side = 16
    at = lambda i, j: i * 100 + j
    nodes = spark.createDataFrame([(at(i, j), -71.24 + j * 0.0011, -34.98 + i * 0.0009) for i in range(side) for j in range(side)], "id long, lon double, lat double")
    edges = []
    for i in range(side):
        for j in range(side):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < side and b < side:
                    infra = i == a == 0
                    row = (100.0, 100.0, 1.0, 1, f"Calle {j if a > i else 50 + i}", "residential", "cycle_lane" if infra else "local_street", "x", infra)
                    edges += [(at(i, j), at(a, b), *row), (at(a, b), at(i, j), *row)]
    e = spark.createDataFrame(edges, "u long, v long, length_m double, cost double, penalty_factor double, way_id long, name string, highway string, category string, infra_label string, is_cycling_infra boolean")
    places = spark.createDataFrame([(k, f"Plaza {k}", -71.24 + 0.0011 * (k % 16), -34.98 + 0.0009 * (k % 15)) for k in range(30)], "id long, name string, lon double, lat double")
    plan = plan_expansion("x", nodes, e, places, 0.8194, 2)
    rows = plan.orderBy("phase").collect()
    assert [r["phase"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    first = rows[0]
    assert first["path"][0] < 100 and first["origin"] == first["path"][0] and first["expansion_type"] in ("branch", "trunk_extension") and first["depends_on"] == []
    assert 500 <= first["length_m"] <= 3500 and first["zigzag_ratio"] <= 1.35 and first["new_nodes"] > 0 and 8 <= first["s_cont"] <= 20 and 5 <= first["s_axis"] <= 10
    assert rows[-1]["cum_nodes"] == sum(r["new_nodes"] for r in rows) and rows[-1]["cum_km"] == pytest.approx(sum(r["length_km"] for r in rows))
    c = coverage(nodes, nodes.filter("id < 100"), 0.8194).first()
    assert c["points"] == side * side and c["covered"] == 4 * side and c["0-250m"] + c["250-500m"] + c["500-1000m"] + c[">1000m"] == side * side


def test_first_requests_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1.0, 2.0, 3.0, 4.0), ("2024-01-01 00:01:00", 1.0000001, 2.0, 3.0, 4.0), ("2024-01-01 00:02:00", 3.0, 4.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "t string, o_lon double, o_lat double, d_lon double, d_lat double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = first_requests(s).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2

"""Building, reporting and serving a city; raw documents; what a client shows."""

import json

import pytest
from pyspark.sql import functions as F

from rodada.plans import build, catalog, reports, service, stack
from rodada.sources import osm, raw, versions

SIDE = 6


def _documents(tmp_path):
    """A lattice of streets of about 100 m, a cycleway along its south, and a registry of three cities."""
    at = lambda i, j: 1 + i * SIDE + j
    nodes = [{"type": "node", "id": at(i, j), "lat": -34.98 + i * 0.0009, "lon": -71.24 + j * 0.0011} for i in range(SIDE) for j in range(SIDE)]
    ways = [{"type": "way", "id": 100 + i, "nodes": [at(i, j) for j in range(SIDE)], "tags": {"highway": "residential" if i else "cycleway", "name": f"Calle {i}"}} for i in range(SIDE)]
    ways += [{"type": "way", "id": 200 + j, "nodes": [at(i, j) for i in range(SIDE)], "tags": {"highway": "residential", "name": f"Norte {j}"}} for j in range(SIDE)]
    (tmp_path / "x.json").write_text(json.dumps({"elements": nodes + ways}))
    place = lambda i, j: [-71.24 + j * 0.0011, -34.98 + i * 0.0009]
    presets = [{"id": str(k), "name": f"P{k}", "coord": place(*c)} for k, c in enumerate([(0, 0), (0, 5), (5, 0), (5, 5)])] + [{"id": "f", "name": "Far", "coord": [0.0, 0.0]}]
    city = {"id": "x", "name": "X", "region": "R", "enabled": True, "center": place(2, 2), "bounds": [place(0, 0), place(5, 5)], "bbox": [-34.98, -71.24, -34.9755, -71.2345], "presets": presets, "representative_routes": []}
    (tmp_path / "registry.json").write_text(json.dumps({"version": "1", "cities": [city, {"id": "y", "name": "Y", "enabled": False}, {"id": "z", "name": "Z", "enabled": True}]}))


def test_build_report_and_serve(spark, tmp_path):
    _documents(tmp_path)
    registry, out = osm.read_registry(spark, str(tmp_path / "registry.json")), str(tmp_path / "out")
    assert sorted(r["id"] for r in catalog.enabled_cities(registry).collect()) == ["x", "z"]
    counts = build.build_city(spark, "x", str(tmp_path / "x.json"), out, registry=registry, publish_to=str(tmp_path / "public"))
    assert counts["cycleways"] == 1 and counts["nodes"] == SIDE * SIDE and counts["routes"] == 3 and counts["components"] == 1
    routes = {r["id"]: r for r in (json.loads(x["value"]) for x in spark.read.text(f"{out}/x/suggested-routes").collect())}
    assert sorted(routes) == ["route-x-01", "route-x-02", "route-x-03"]
    first = routes["route-x-01"]["properties"]
    assert first["name"] == "Ruta #01: P1 → P0" and first["origin_name"] == "P1" and first["cycling_infra_pct"] == 100.0 and first["streets"] == ["Calle 0"] and first["status"] == "ALGORITHMIC_RECOMMENDED"
    assert len(routes["route-x-03"]["geometry"]["coordinates"]) == 2 * SIDE - 1
    documents = {r["layer"]: r for r in osm.read_layers(spark, f"{tmp_path}/public/x/*.geojson").collect()}
    assert {k: r["feature_count"] for k, r in documents.items()} == {"cycling-infrastructure": 1, "suggested-routes": 3, "missing-connections": 0} and not list((tmp_path / "public" / "x").glob("*.tmp"))
    assert json.loads((tmp_path / "public" / "x" / "cycling-infrastructure.geojson").read_text())["metadata"]["cycleways_count"] == 1
    city = json.loads(spark.read.text(f"{tmp_path}/public/x/city").first()["value"])
    assert city["stats"]["cycleways_count"] == 1 and city["stats"]["total_km"] == pytest.approx(0.5, abs=0.02) and city["connectivity"]["total_components"] == 1 and city["connectivity"]["main_component_pct"] == 100.0
    assert city["description"] == "Red ciclista y análisis de conectividad urbana para X, R." and city["country"] == "Chile" and len(city["presets"]) == 5
    nodes, edges = service.city_graph(spark, out, "x")
    assert nodes.count() == SIDE * SIDE and service.city_graph(spark, out, "y") is None and service.city_graph(spark, f"{out}/no", "x") is None
    details = spark.createDataFrame([("x",), ("y",)], "id string")
    o, d = [-71.24, -34.98], [-71.2345, -34.98]
    asked = [(1, "x", 1, o, d, None, None), (2, "x", 2, o, d, None, "balanced"), (3, "x", 3, o, d, None, "direct"), (4, "x", 4, [-71.2, -34.98], d, 400.0, None), (5, "x", 5, [1.0], d, None, None), (6, "q", 6, o, d, None, None), (7, "y", 7, o, d, None, None), (8, "x", 8, [-71.2401, -34.98], d, 5.0, None)]
    requests = spark.createDataFrame(asked, "id long, city_id string, seq long, origin array<double>, destination array<double>, max_snap_dist_m double, profile string")
    got = {r["id"]: r for r in service.answer_routes(spark, requests, details, out).collect()}
    assert {i: r["error"] for i, r in got.items()} == {1: None, 2: None, 3: None, 4: "out_of_bounds", 5: "invalid_coordinates", 6: "city_not_found", 7: "graph_not_found", 8: "out_of_bounds"}
    assert [got[i]["cached"] for i in (1, 2, 3)] == [False, True, False] and got[1]["cycling"]["cycling_infra_pct"] == 100.0
    cache = f"{out}/cache"
    assert service.load_route_cache(spark, cache) is None
    service.save_route_cache(service.answer_routes(spark, requests.filter("id = 1"), details, out, cache), cache)
    again = {r["id"]: r for r in service.answer_routes(spark, requests, details, out, cache).collect()}
    assert [again[i]["cached"] for i in (1, 2, 3)] == [True, True, False] and again[2]["cycling"] == got[2]["cycling"] and {i: r["error"] for i, r in again.items()} == {i: r["error"] for i, r in got.items()}
    other = requests.filter("id = 1").withColumn("destination", F.array(F.lit(-71.2345), F.lit(-34.9755)))
    service.save_route_cache(service.answer_routes(spark, other, details, out, cache), cache)
    assert service.load_route_cache(spark, cache).count() == 2 and versions.vacuum(spark, cache) and service.load_route_cache(spark, cache).count() == 2


def test_routes_of_many_cities_are_one_plan(spark, tmp_path):
    from rodada.sources.sinks import write_graph

    edge = "u long, v long, length_m double, cost double, penalty_factor double, way_id long, name string, highway string, category string, infra_label string, is_cycling_infra boolean"
    for c, (shift, step) in {"a": (0.0, 0.001), "b": (0.0, 0.001), "c": (0.2, 0.002)}.items():  # a and b lie in one spot and share ids
        nodes = spark.createDataFrame([(i, -71.24 + i * step, -34.98 + shift) for i in range(6)], "id long, lon double, lat double")
        rows = [(i, i + 1, 90.0 + ord(c), 80.0, 1.0, i, f"{c}{i}", "residential", "local_street", "x", False) for i in range(5)]
        write_graph(nodes, spark.createDataFrame(rows, edge), str(tmp_path), c)
    asked = [(k, c, k, [-71.24, -34.98 + s], [-71.24 + 3 * t, -34.98 + s]) for k, (c, s, t) in enumerate((("a", 0.0, 0.001), ("b", 0.0, 0.001), ("c", 0.2, 0.002), ("a", 0.2, 0.002)))]
    requests = spark.createDataFrame(asked, "id long, city_id string, seq long, origin array<double>, destination array<double>")
    details = spark.createDataFrame([(c,) for c in "abc"], "id string")
    got = {r["id"]: r for r in service.answer_routes(spark, requests, details, str(tmp_path)).collect()}
    assert [got[k]["error"] for k in range(4)] == [None, None, None, "out_of_bounds"]
    for k, c in enumerate("abc"):
        alone = service.answer_routes(spark, requests.filter(F.col("id") == k), details, str(tmp_path)).first()
        assert got[k].asDict(True) == alone.asDict(True) and got[k]["cycling"]["path"] == [0, 1, 2, 3] and got[k]["cycling"]["streets"] == [f"{c}{i}" for i in range(3)] and got[k]["cycling"]["distance_m"] == 3 * (90 + ord(c))
    bad = spark.createDataFrame([("x", -1, 0.0, 0.0)], "city string, id long, lon double, lat double")
    with pytest.raises(ValueError, match="ids of nodes"):
        stack.city_numbers(bad)


def test_versions_keep_what_a_merge_does_not_name(spark, tmp_path):
    path, row = str(tmp_path / "t"), "city string, key string, v int, extra string"
    assert versions.current(spark, path) is None and versions.vacuum(spark, path) == []
    versions.merge(spark.createDataFrame([("a", "1", 1, "x"), ("a", "1", 3, "y"), (None, "2", 5, None)], row), path, ("city", "key"), latest="v")
    before = versions.current(spark, path)
    versions.merge(spark.createDataFrame([("b", "1", 7, None), (None, "2", 6, "z")], row), path, ("city", "key"), latest="v")
    show = lambda df: sorted(map(str, ((r["city"], r["key"], r["v"]) for r in df.collect())))
    assert show(before) == ["('a', '1', 3)", "(None, '2', 5)"] and show(versions.current(spark, path)) == ["('a', '1', 3)", "('b', '1', 7)", "(None, '2', 6)"]
    with pytest.raises(Exception):  # noqa: B017  a merge that fails
        versions.merge(spark.createDataFrame([("c", "1", 1, "")], row).withColumn("v", F.raise_error(F.lit("no")).cast("int")), path, ("city", "key"))
    assert versions.current(spark, path).count() == 3 and len(versions.vacuum(spark, path)) >= 1 and versions.current(spark, path).count() == 3


def test_expansion_totals_and_upsert(spark):
    plan = spark.createDataFrame([(1, 0.9, 217, 24, "branch", "urban"), (2, 0.63, 226, 12, "branch", "uncertain"), (3, 0.92, 129, 8, "cross_connector", "urban")], "phase int, length_km double, new_nodes long, new_pois long, expansion_type string, urban_context string")
    base = spark.createDataFrame([(5000, 2000, 40.0)], "points long, covered long, covered_pct double")
    t = reports.expansion_totals(plan, base).first()
    assert (t["total_phases"], t["total_expansion_km"], t["total_new_nodes"], t["total_new_pois"], t["total_coverage_gain_pct"]) == (3, 2.45, 572, 44, 11.4)
    assert t["expansion_types_summary"] == {"branch": 2, "cross_connector": 1} and t["urban_contexts_summary"] == {"urban": 2, "uncertain": 1}
    assert reports.expansion_totals(plan.limit(0), base).first()["expansion_types_summary"] == {}
    document = spark.createDataFrame([("x", 1)], "id string, expansion int")
    new = reports.with_expansion(document, spark.createDataFrame([(2, 7)], "total_phases int, total_new_nodes long"), F.lit("now")).first()
    assert new["id"] == "x" and new["expansion"]["total_new_urban_access_nodes"] == 7 and new["expansion"]["last_analyzed"] == "now"
    gaps = spark.createDataFrame([(308.4, 75.9), (75.0, 70.0), (834.0, 60.0), (369.9, 50.0)], "gap_length_m double, priority_score double")
    assert tuple(reports.gap_totals(gaps).first()) == (4, 369, 75.9) and tuple(reports.gap_totals(gaps.limit(0)).first()) == (0, 0, 0.0)


def test_answers_about_cities_and_layers(spark):
    assert service.health(spark, {"ENVIRONMENT": "test"}).first()["environment"] == "test"
    assert service.settings({"CORS_ORIGINS": " a, ,b ", "PORT": "9"}) == {"host": "0.0.0.0", "port": 9, "environment": "development", "cors_origins": ["a", "b"], "data_dir": "data/cities"}
    files = spark.createDataFrame([("x", "missing-connections", 2, ["{}", "{}"])], "city string, layer string, feature_count int, features array<string>")
    details = spark.createDataFrame([("x", "X", 1)], "id string, name string, secret int")
    assert service.declared(details).columns == ["id", "name"]
    found = service.city_detail(spark, details, files, "x").first()
    assert found["error"] is None and [(a["id"], a["feature_count"]) for a in found["available_layers"]] == [("missing-connections", 2)]
    assert service.city_detail(spark, details, files, "q").first()["error"] == "city_not_found"
    assert len(service.layer_answer(spark, files, "x", "missing-connections").first()["features"]) == 2 and service.layer_answer(spark, files, "x", "no").first()["error"] == "layer_not_found"


def test_raw_documents(spark, tmp_path):
    asked, naps = [], []

    def fetch(mirror):
        asked.append(mirror)
        if mirror != "c":
            raise OSError(mirror)
        return json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}]})

    path = f"file://{tmp_path}/raw/e.json"
    read = lambda: raw.read_through(spark, path, ["a", "b", "c"], fetch, osm.read_elements, sleep=naps.append).count()
    assert read() == 1 and asked == ["a", "a", "b", "b", "c"] and naps == [2.0, 4.0, 2.0, 4.0]
    assert read() == 1 and len(asked) == 5
    assert raw.read_through(spark, path, ["c"], fetch, osm.read_elements, refresh=True).count() == 1 and len(asked) == 6
    with pytest.raises(ConnectionError):
        raw.first_answer(["a"], fetch, attempts=1, sleep=naps.append)
    for name, text in (("b", '{"id": "b", "name": "B"}'), ("a", '{"id": "a", "name": "A"}'), ("c", "{broken")):
        (tmp_path / "cities" / name).mkdir(parents=True)
        (tmp_path / "cities" / name / "city.json").write_text(text)
    assert [r["id"] for r in osm.read_city_documents(spark, f"{tmp_path}/cities/*/city.json").collect()] == ["a", "b"]
    assert raw.publish(spark, f"{tmp_path}/cities", f"{tmp_path}/out", ["a", "no"]) == ["a"] and (tmp_path / "out" / "a" / "city.json").exists()


def test_all_cities_are_planned_by_one_command(spark, tmp_path, capsys):
    from test_expansion import COS, EDGE, _cities, _city

    from rodada.operators.expansion import cluster_report
    from rodada.sources.sinks import write_graph

    parts = {"a": _city("a", 0, 12, 0, 1), "b": _city("b", 0, 10, 0, 2)}
    out = str(tmp_path / "out")
    for c, (nodes, edges, places) in parts.items():
        write_graph(spark.createDataFrame([n[2:] for n in nodes], "id long, lon double, lat double"), spark.createDataFrame(edges, EDGE), out, c)
        elements = [{"type": "node", "id": p[2], "lat": p[5], "lon": p[4], "tags": {"amenity": "school", "name": f"{p[3]} {p[2]}"}} for p in places]
        (tmp_path / f"{c}.json").write_text(json.dumps({"elements": elements}))
    (tmp_path / "r.json").write_text(json.dumps({"version": "1", "cities": [{"id": c, "enabled": c != "z"} for c in "abz"]}))
    build.main([str(tmp_path / "r.json"), str(tmp_path), out, "--all-enabled", "--plan-only", "--max-phases", "1"])
    rows = spark.read.parquet(f"{out}/expansions").collect()
    assert sorted(r["city_id"] for r in rows) == ["a", "b"] and all(max(r["path"]) < 144 and len(r["coordinates"]) == len(r["path"]) for r in rows) and "length_km" in capsys.readouterr().out
    nodes, edges, places = _cities(spark, _city("a", 0, 12, 0, 1), _city("b", 1000, 12, 0, 2))
    clusters = cluster_report(nodes, edges, places, min_samples=6).collect()
    assert sorted((r["city"], r["id"]) for r in clusters) == [("a", "cluster-a-01"), ("b", "cluster-b-01")] and all(r["node_count"] > 20 and r["min_lat" if "min_lat" in r else "bbox"] and r["mean_distance_to_cycle_network"] > 400 for r in clusters)
    n, e, p = _cities(spark, _city("a", 0, 12, 0, 1))
    from rodada.operators import expansion

    totals = build.plan_city(spark, "a", n.drop("city", "cos_lat"), e, p.drop("city", "cos_lat"), out, COS["a"], 1)
    layer = json.loads((tmp_path / "out" / "a" / "network-expansion.geojson").read_text())
    assert totals.first()["total_phases"] == 1 == layer["metadata"]["total_phases"] and layer["features"][0]["id"] == "expansion-a-01" and layer["metadata"]["expansion_types_summary"] and layer["crs"]
    assert isinstance(layer["metadata"]["clusters"], list) and expansion.COVER_M == 400.0
    before = (tmp_path / "out" / "a" / "network-expansion.geojson").read_text()
    with pytest.raises(Exception):  # noqa: B017  a task that fails leaves the old document
        raw.place_text(spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("value")), f"{out}/a/network-expansion.geojson")
    assert (tmp_path / "out" / "a" / "network-expansion.geojson").read_text() == before

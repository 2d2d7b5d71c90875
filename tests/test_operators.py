"""Graph, spatial, cluster and routing operators against brute force on small inputs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from rodada.operators import cluster, gaps, graph, iterative, pois, routing, spatial

COS = 0.82


def _d(a, b):
    return math.hypot((a[0] - b[0]) * COS, a[1] - b[1]) * 111320


def _cloud(n, seed, span=0.02):
    r = random.Random(seed)
    return [(i, -71.24 + r.random() * span, -34.98 + r.random() * span) for i in range(n)]


@pytest.mark.parametrize("small", [0, iterative.SMALL])
def test_connected_components(spark, small):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["node"]: x["component"] for x in iterative.connected_components(spark.createDataFrame(edges, "src long, dst long"), small=small).collect()}
    assert got == {x: find(x) for x in list(root)}


@pytest.mark.parametrize("small", [0, 30, iterative.SMALL])
def test_first_fit_equals_sequential_pass(spark, small):
    r = random.Random(5)
    pairs = sorted({(max(a, b), min(a, b)) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(70)) if a != b})
    kept = []
    for i in range(40):
        if not any((i, k) in pairs for k in kept):
            kept.append(i)
    got = iterative.first_fit(spark.range(40), spark.createDataFrame(pairs, "later long, earlier long"), small)
    assert sorted(x["id"] for x in got.collect()) == kept


def test_first_fit_of_a_long_chain(spark):
    chain = spark.range(1, 3000).selectExpr("id as later", "id - 1 as earlier")
    assert sorted(x["id"] for x in iterative.first_fit(spark.range(3000), chain).collect()) == list(range(0, 3000, 2))


@pytest.mark.parametrize("small", [0, iterative.SMALL])
def test_bounded_paths(spark, small):
    r = random.Random(7)
    edges = {(a, b): float(r.randrange(1, 50)) for a, b in ((r.randrange(20), r.randrange(20)) for _ in range(70)) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")
    got = {(x["query"], x["node"]): x for x in iterative.bounded_paths(df, spark.createDataFrame([(0, 0), (3, 3)], "query long, node long"), 80.0, small=small).collect()}
    want = {}
    for s in (0, 3):
        heap, done = [(0.0, s)], {}
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = d
            heap += [(d + w, v) for (a, v), w in edges.items() if a == u and d + w <= 80]
            heapq.heapify(heap)
        want |= {(s, u): d for u, d in done.items()}
    assert {k: x["dist"] for k, x in got.items()} == pytest.approx(want)
    plain = iterative.bounded_paths(df, spark.createDataFrame([(0, 0), (3, 3)], "query long, node long"), 80.0, small=small, paths=False)
    assert plain.columns == ["query", "node", "dist"] and {(x["query"], x["node"]): x["dist"] for x in plain.collect()} == pytest.approx(want)
    for (s, u), x in got.items():
        assert x["path"][0] == s and x["path"][-1] == u and sum(edges[p] for p in zip(x["path"], x["path"][1:])) == pytest.approx(x["dist"])


def test_spatial_joins(spark):
    a, b = _cloud(60, 1), _cloud(40, 2)
    fa, fb = (spark.createDataFrame(x, "id long, lon double, lat double") for x in (a, b))
    want = {(p[0], q[0]) for p in a for q in b if _d(p[1:], q[1:]) <= 300}
    assert {(x["l_id"], x["r_id"]) for x in spatial.radius_pairs(fa, fb, 300.0, COS).collect()} == want
    assert {x["id"] for x in spatial.radius_semi(fa, fb, 300.0, COS).collect()} == {p for p, _ in want}
    assert {x["id"] for x in spatial.radius_semi(fa, fb, 300.0, COS, anti=True).collect()} == {p[0] for p in a} - {p for p, _ in want}
    assert {x["id"]: x["n"] for x in spatial.radius_count(fa, fb, 300.0, COS).collect()} == {p[0]: sum(k[0] == p[0] for k in want) for p in a}
    near = {x["id"]: (x["near_id"], x["near_m"]) for x in spatial.nearest(fa, fb, COS, 150.0).collect()}
    for p in a:
        d, q = min((_d(p[1:], q[1:]), q[0]) for q in b)
        assert near[p[0]] == (q, pytest.approx(d))
    far = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id long, lon double, lat double")
    got = {x["id"]: x["near_id"] for x in spatial.nearest(far, fb, COS).collect()}
    assert got[2] is None and got[1] is not None


@pytest.mark.parametrize("few", [4, 0])
def test_dbscan_border_rule(spark, monkeypatch, few):
    monkeypatch.setattr(cluster, "_FEW", few)  # 0: cells meet by nearest neighbours alone
    for seed in (1, 4) if few else (4,):
        pts = _cloud(90, seed, 0.006)
        near = {p[0]: [q[0] for q in pts if _d(p[1:], q[1:]) <= 100] for p in pts}
        visited, clusters = set(), {}
        assigned: set = set()
        for i, *_ in pts:  # a search in id order
            if i in visited:
                continue
            visited.add(i)
            if len(near[i]) < 6:
                continue
            members, queue = [i], [x for x in near[i] if x != i]
            while queue:
                q = queue.pop(0)
                if q not in visited:
                    visited.add(q)
                    if len(near[q]) >= 6:
                        queue += [x for x in near[q] if x not in visited]
                if q not in members:
                    members.append(q)
            clusters[i] = set(members)
            assigned |= clusters[i]
        got: dict = {}
        for x in cluster.dbscan(spark.createDataFrame(pts, "id long, lon double, lat double"), COS, 100.0, 6).collect():
            got.setdefault(x["cluster"], set()).add(x["id"])
        assert got == clusters


def test_dbscan_of_crowds_makes_few_pairs(spark, monkeypatch):
    """Two crowds of 400 in one eps, and a few points between: no crowd is compared with itself or with the other."""
    r = random.Random(3)
    pts = [(i, -71.0 + r.random() * 0.0004, -34.0 + r.random() * 0.0004) for i in range(400)] + [(400 + i, -70.9986 + r.random() * 0.0004, -34.0 + r.random() * 0.0004) for i in range(400)] + [(900 + i, -70.9975 + 0.0004 * i, -34.0) for i in range(3)]
    made, real = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df: made.append(out := real(df)) or out)
    got = cluster.dbscan(spark.createDataFrame(pts, "id long, lon double, lat double"), COS, 100.0, 6).collect()
    near = {p[0]: sum(_d(p[1:], q[1:]) <= 100 for q in pts) for p in pts}
    assert {x["id"] for x in got if x["is_core"]} == {i for i, n in near.items() if n >= 6}
    assert sum(near.values()) > 200_000 and max(df.count() for df in made) < 25 * 6 * len(pts)


def test_components_with_lone_node(spark):
    nodes = spark.createDataFrame([(i, -71.24 + i * 0.001, -34.98) for i in range(1, 7)], "id long, lon double, lat double")
    folded = spark.createDataFrame([(1, 2, 500.0), (2, 3, 500.0), (4, 5, 300.0)], "a long, b long, length_m double")
    c = graph.components(folded, nodes, spark.createDataFrame([(6,)], "node long")).orderBy("id").collect()
    assert [(x["node_count"], x["length_m"], x["endpoints"]) for x in c] == [(3, 1000.0, [1, 3]), (2, 300.0, [4, 5]), (1, 0.0, [6])]


def _line(spark):
    nodes = spark.createDataFrame([(i, -71.24 + i * 0.001, -34.98) for i in range(6)], "id long, lon double, lat double")
    pos = spark.createDataFrame([(1, k, n) for k, n in enumerate((0, 1, 2))] + [(2, k, n) for k, n in enumerate((2, 3, 99, 4))] + [(3, k, n) for k, n in enumerate((1, 2))], "way_id long, pos long, node long")
    tags = spark.createDataFrame([(1, {"highway": "cycleway"}), (2, {"highway": "residential", "name": "Uno", "oneway": "yes"}), (3, {"highway": "service"})], "way_id long, tags map<string,string>")
    return nodes, pos, tags


def test_edges_last_write_wins_and_holes_break(spark):
    nodes, pos, tags = _line(spark)
    e = {(x["u"], x["v"]): x for x in graph.directed_edges(pos, tags, nodes).collect()}
    assert set(e) == {(0, 1), (1, 0), (1, 2), (2, 1), (2, 3)}
    assert e[0, 1]["is_cycling_infra"] and not e[1, 2]["is_cycling_infra"] and e[1, 2]["way_id"] == 3
    assert e[2, 3]["name"] == "Uno" and e[0, 1]["name"] == "Calle sin nombre" and e[0, 1]["cost"] == pytest.approx(e[0, 1]["length_m"] * 0.78, abs=0.01)
    ways = spark.createDataFrame([(2, [2, 3, 99, 4]), (5, [1, 77])], "id long, nodes array<long>")
    lines = {x["way_id"]: x for x in graph.way_lines(ways, nodes).collect()}
    assert set(lines) == {2} and len(lines[2]["coords"]) == 3


def test_routes_and_errors(spark):
    nodes, pos, tags = _line(spark)
    edges = graph.directed_edges(pos, tags, nodes)
    at = lambda i: (-71.24 + i * 0.001, -34.98)
    reqs = [(1, *at(0), *at(3)), (2, *at(3), *at(0)), (3, 0.0, 0.0, *at(1)), (4, *at(1), *at(1))]
    got = {x["id"]: x for x in routing.route_batch(spark.createDataFrame(reqs, "id long, o_lon double, o_lat double, d_lon double, d_lat double"), nodes, edges, COS).collect()}
    assert got[1]["error"] is None and got[1]["cycling"]["path"] == [0, 1, 2, 3] and got[1]["comparison"]["is_same_path"] and got[1]["cycling"]["streets"] == ["Calle sin nombre", "Uno"]
    assert got[2]["error"] == "no_route" and got[3]["error"] == "out_of_bounds" and got[4]["cycling"]["distance_m"] == 0


def test_poi_dedup_equals_sequential_pass(spark):
    r = random.Random(9)
    rows = [(i, r.choice(["Plaza Uno", "plaza uno!", "Sin nombre", "Otra", "Ú"]), r.choice("ab"), lon, lat) for i, lon, lat in _cloud(60, 11, 0.005)]
    norm = {"Plaza Uno": "plaza uno", "plaza uno!": "plaza uno", "Sin nombre": "sin nombre", "Otra": "otra", "Ú": "u"}
    kept: list = []
    for p in rows:
        n = norm[p[1]]
        if not any(_d(p[3:], k[3:]) < 15 or (_d(p[3:], k[3:]) < 150 and p[2] == k[2] and n != "sin nombre" and (n in norm[k[1]] or norm[k[1]] in n)) for k in kept):
            kept.append(p)
    got = pois.deduplicate_pois(spark.createDataFrame(rows, "id long, name string, category string, lon double, lat double"), COS)
    assert sorted(x["id"] for x in got.collect()) == [k[0] for k in kept]


def test_parse_pois(spark):
    rows = [(1, -71.0, -34.0, None, {"amenity": "school"}), (2, None, None, (-71.1, -34.1), {"shop": "mall", "name": "M"}), (3, None, None, None, {}), (4, 0.0, 0.0, (-71.2, -34.2), None)]
    got = pois.parse_pois(spark.createDataFrame(rows, "id long, lon double, lat double, center struct<lon:double,lat:double>, tags map<string,string>")).orderBy("id").collect()
    assert [(x["id"], x["name"], x["category"], x["lon"]) for x in got] == [(1, "Sin nombre", "education", -71.0), (2, "M", "commercial", -71.1), (4, "Sin nombre", "other", -71.2)]


def test_gap_overlap_rule(spark):
    c = lambda a, b, s, path: (a, b, path[0], path[-1], s, path)
    rows = [c(1, 2, 90.0, [1, 2, 3, 4]), c(1, 2, 95.0, [5, 6, 7, 8]), c(1, 3, 80.0, [5, 6, 7, 9]), c(2, 3, 70.0, [10, 11])]
    got = gaps.rank_gaps(spark.createDataFrame(rows, "comp_a_id int, comp_b_id int, node_origin long, node_dest long, priority_score double, path_nodes array<long>"), 10).orderBy("rank").collect()
    assert [(x["rank"], x["priority_score"]) for x in got] == [(1, 95.0), (2, 70.0)]


def test_cache(spark):
    rows = [(0, 1.0, 2.0, 3.0, 4.0, "balanced"), (1, 1.0000001, 2.0, 3.0, 4.0, "balanced"), (2, 1.0, 2.0, 3.0, 4.0, "direct"), (3, 3.0, 4.0, 1.0, 2.0, "balanced"), (4, 1.0, 2.0, 3.0, 4.0, "balanced")]
    out = routing.cache_outcome(spark.createDataFrame(rows, "seq long, o_lon double, o_lat double, d_lon double, d_lat double, profile string")).orderBy("seq").collect()
    assert [x["cached"] for x in out] == [False, True, False, False, True]
    replay = list(routing.cache_replay([{"key": x["key"], "profile": x["profile"]} for x in out]))
    assert replay == [False, True, False, False, True]
    keys = [{"key": str(i), "profile": "balanced"} for i in (1, 2, 3, 1)]
    assert list(routing.cache_replay(keys, capacity=2)) == [False, False, False, False]


def test_gap_candidates_end_to_end(spark):
    nodes = [(i, -71.24 + i * 0.001, -34.98) for i in range(12)]
    infra = lambda i: i < 4 or i > 6
    edges = [(a, b, 91.0, 91.0, 1.05, 1, "Uno", "residential", "cycle_lane" if infra(i) else "local_street", "x", infra(i)) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))]
    e = spark.createDataFrame(edges, "u long, v long, length_m double, cost double, penalty_factor double, way_id long, name string, highway string, category string, infra_label string, is_cycling_infra boolean")
    n = spark.createDataFrame(nodes, "id long, lon double, lat double")
    comps = graph.components(graph.cycling_edges(e), n)
    got = gaps.rank_gaps(gaps.gap_candidates(e, n, comps, COS), 10).collect()
    assert len(got) == 1 and got[0]["path_nodes"] == [4, 5, 6, 7] and got[0]["gap_length_m"] == 273.0
    feature = gaps.gap_features(spark.createDataFrame(got), F.lit("x")).first()
    assert feature["id"] == "gap-x-01" and feature["gap_length_m"] == 273 and len(feature["coordinates"]) == 4

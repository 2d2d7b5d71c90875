"""The planner: all cities in one job, corridor searches against brute force, gaps and components by city."""

import heapq
import random

from pyspark.sql import functions as F

from rodada.operators import expansion, gaps, graph
from rodada.operators.cells import CellSearch, id_cells
from rodada.operators.expansion import corridor_edges, plan_cities, plan_expansion, reach_origins

EDGE = "u long, v long, length_m double, cost double, penalty_factor double, way_id long, name string, highway string, category string, infra_label string, is_cycling_infra boolean"
COS = {"a": 0.82, "b": 0.9, "c": 0.82, "d": 0.82}


def _city(name, first, side, infra_row, seed):
    """A lattice city: nodes, edges with a cycleway along one row, places. All cities lie in the same spot."""
    r = random.Random(seed)
    at = lambda i, j: first + i * side + j
    nodes = [(name, COS[name], at(i, j), -71.24 + j * 0.0011, -34.98 + i * 0.0009) for i in range(side) for j in range(side)]
    edges = []
    for i in range(side):
        for j in range(side):
            for k, (a, b) in enumerate(((i, j + 1), (i + 1, j))):
                if a < side and b < side:
                    infra = i == a == infra_row
                    kind = "secondary" if i == a == infra_row + 6 else r.choice(("residential", "residential", "tertiary"))
                    row = (100.0, 100.0, 1.0, i, f"Calle {i if k == 0 else 50 + j}", kind, "cycle_lane" if infra else "local_street", "x", infra)
                    edges += [(at(i, j), at(a, b), *row), (at(a, b), at(i, j), *row)]
    places = [(name, COS[name], first + k, f"Plaza {k}", -71.24 + r.randrange(side) * 0.0011, -34.98 + r.randrange(side) * 0.0009) for k in range(12)]
    return nodes, edges, places


def _cities(spark, *cities):
    all_ = [sum((c[k] for c in cities), []) for k in range(3)]
    return spark.createDataFrame(all_[0], "city string, cos_lat double, id long, lon double, lat double"), spark.createDataFrame(all_[1], EDGE), spark.createDataFrame(all_[2], "city string, cos_lat double, id long, name string, lon double, lat double")


def test_three_cities_in_one_run_equal_three_runs(spark):
    parts = {"a": _city("a", 0, 14, 0, 1), "b": _city("b", 10_000, 12, 2, 2), "c": _city("c", 20_000, 10, 0, 3), "d": _city("d", 30_000, 6, 99, 4)}
    nodes, edges, places = _cities(spark, *parts.values())
    plan = plan_cities(nodes, edges, places, 2, 6)
    show = lambda rows: sorted(str(sorted(r.asDict(recursive=True).items())) for r in rows)
    got = {c: plan.filter(F.col("city") == c).drop("city").collect() for c in parts}
    for c, phases in (("a", 2), ("b", 1), ("c", 1)):
        n, e, p = _cities(spark, parts[c])
        alone = plan_expansion(c, n.drop("city", "cos_lat"), e, p.drop("city", "cos_lat"), COS[c], phases, 6)
        assert show(r for r in got[c] if r["phase"] <= phases) == ([] if alone is None else show(alone.collect()))
    assert [r["phase_id"] for r in sorted(got["a"], key=lambda r: r["phase"])] == ["expansion-a-01", "expansion-a-02"] and got["b"] and not got["d"]
    nothing = plan_cities(*(_cities(spark, parts["d"])), 2, 6)
    assert nothing.collect() == [] and nothing.dtypes == plan.dtypes


def test_corridors_start_at_the_nearest_origins_and_take_the_first_of_equal_paths(spark):
    _, edges, _ = city = _city("a", 0, 9, 0, 5)
    hops = corridor_edges(spark.createDataFrame(edges, EDGE)).cache()
    cost = {(r["profile"], r["u"], r["v"]): r["cost"] for r in hops.collect()}
    search = CellSearch(hops.select(F.col("profile").alias("graph"), "u", "v", F.col("cost").alias("w")), id_cells(spark.createDataFrame(city[0]).select(F.col("_3").alias("node")), 20), 1000.0, digits=6)
    targets, origins = (80, 44), [0, 3, 8, 40, 12]
    got = reach_origins(spark.createDataFrame([(t, 1) for t in targets], "id long, rank int"), search, spark.createDataFrame([(o,) for o in origins], "id long")).collect()
    want = {}
    for t in targets:
        for p in ("direct", "structural"):
            best, heap = {}, [(0.0, [t])]
            while heap:  # paths from the origin to the target, the smallest of each cost first
                d, path = heapq.heappop(heap)
                if path[0] in best and best[path[0]] <= (d, path):
                    continue
                best[path[0]] = (d, path)
                for (q, u, v), c in cost.items():
                    if q == p and u == path[0] and round(d + c, 6) <= 1000.0 and (round(d + c, 6), [v, *path]) < best.get(v, (2000.0, [])):
                        heapq.heappush(heap, (round(d + c, 6), [v, *path]))
            near = sorted((best[o][0], o) for o in origins if o in best)[:2]
            want |= {(t, p, k): best[o] for k, (_, o) in enumerate(near)}
    assert {(r["target"], r["profile"], r["place"]): (r["dist"], r["path"]) for r in got} == want and len(want) == 8
    hops.unpersist()


def test_components_and_gaps_count_within_a_city(spark):
    parts = [_city("a", 0, 8, 0, 1), _city("b", 1000, 8, 1, 1)]
    for nodes, edges, _ in parts:  # a second cycleway row, a gap of two blocks apart from the first
        row = {n[2] for n in nodes if abs(n[4] - (-34.98 + 4 * 0.0009)) < 1e-9}
        edges[:] = [(*e[:8], "cycle_lane", "x", True) if e[0] in row and e[1] in row else e for e in edges]
    nodes, edges, _ = _cities(spark, *parts)
    comps = graph.components(graph.cycling_edges(edges), nodes, by=("city",))
    assert sorted((r["city"], r["id"], r["node_count"]) for r in comps.collect()) == [("a", 1, 8), ("a", 2, 8), ("b", 1, 8), ("b", 2, 8)]
    ranked = gaps.rank_gaps(gaps.gap_candidates(edges, nodes, comps, "cos_lat", by=("city",)), 10, by=("city",)).collect()
    assert {c: [r["rank"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["city"] == c] for c in "ab"} == {"a": [1], "b": [1]}
    for c, part in zip("ab", parts, strict=True):
        n, e, _ = _cities(spark, part)
        one = graph.components(graph.cycling_edges(e), n)
        alone = gaps.rank_gaps(gaps.gap_candidates(e, n, one, COS[c]), 10).collect()
        assert [r.asDict() for r in alone] == [{k: v for k, v in r.asDict().items() if k != "city"} for r in ranked if r["city"] == c]


def test_coverage_by_city(spark):
    nodes, edges, _ = _cities(spark, _city("a", 0, 10, 0, 1), _city("b", 1000, 6, 0, 2))
    access, active = expansion.points(graph.access_nodes(edges, ("residential",)), nodes), expansion.points(graph.cycling_nodes(edges), nodes)
    got = {r["city"]: (r["points"], r["covered"]) for r in expansion.coverage(access, active, "cos_lat", ("city",)).collect()}
    assert set(got) == {"a", "b"} and got["b"][0] == got["b"][1] + sum(1 for r in access.collect() if r["city"] == "b" and round((r["lat"] + 34.98) / 0.0009) >= 4 and (r["lat"] + 34.98) * 111320 > 400) and got["a"][1] < got["a"][0]


def test_anchors_take_short_plans_and_the_closest_place(spark, monkeypatch):
    from math import hypot

    from rodada.functions.geo import DEGREE_M

    nodes, edges, places = _cities(spark, _city("a", 0, 20, 0, 7), _city("b", 10_000, 18, 2, 8))
    places = places.unionByName(spark.createDataFrame([("a", COS["a"], 900 + k, f"Lejos {k}", -70.0, -34.0) for k in range(3)], places.schema)).cache()
    members = nodes.select("city", "cos_lat", F.when(F.col("city") == "a", 0).otherwise(10_000).cast("long").alias("cluster"), F.lit(1).cast("long").alias("rank"), "id", "lon", "lat").cache()
    wide, real = [], expansion.cut
    monkeypatch.setattr(expansion, "cut", lambda df: wide.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or real(df))
    got = expansion.cut(expansion.anchors(members, places, expansion.node_streets(edges))).collect()
    assert max(wide) <= 30, wide  # a plan is held by the driver, with all that it broadcasts
    assert sorted((r["city"], r["second"]) for r in got) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    for r in got:
        far = lambda p, r=r: (hypot((p["lon"] - r["lon"]) * r["cos_lat"], p["lat"] - r["lat"]) * DEGREE_M, p["id"])
        near = min((p for p in places.collect() if p["city"] == r["city"]), key=far)
        label = f"Sector {r['main_street']}" + (f" / {near['name']}" if far(near)[0] < 400 else "")
        assert r["size"] == {"a": 400, "b": 324}[r["city"]] and (r["second"] or r["sector"] == label)
    assert any(" / " in r["sector"] for r in got)


def test_a_phase_takes_short_plans_and_gives_back_what_they_held(spark, monkeypatch):
    nodes, edges, places = _cities(spark, _city("a", 0, 14, 0, 1))
    wide, freed, real = [], [], expansion.cut
    monkeypatch.setattr(expansion, "cut", lambda df: wide.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or real(df))
    monkeypatch.setattr(expansion, "free", lambda session: freed.append(len(wide)), raising=False)
    phases = plan_cities(nodes, edges, places, 2, 6).collect()
    assert len(phases) == 2 and len(freed) == 2
    assert max(wide) <= 16, wide

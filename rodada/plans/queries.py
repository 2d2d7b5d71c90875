"""Registered queries over the derived road network, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rodada.functions import geo, scores, tags, text
from rodada.operators import cluster, gaps, graph, groups, pois, routing, spatial
from rodada.operators.cells import NEAR_NODES, node_cells
from rodada.operators.iterative import bounded_paths, first_fit
from rodada.operators.work import cut
from rodada.plans import catalog
from rodada.plans.fixtures import COS_LAT, ctes, fixture, way_tags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments -------------------------------------------------------------------------------------------------


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(power(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-{lon1})/2),2))"
    return f"(2*6371000.0*atan2(sqrt({h}),sqrt(1-{h})))"


def _planar(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(sqrt(power(({lon2}-{lon1})*{COS_LAT}e0,2)+power({lat2}-{lat1},2))*111320.0)"


def _rounded(x: str, n: int) -> str:
    """Half up on the value's shortest decimal form, like Spark: DuckDB's own rounding of doubles scales them first."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)),{n}) AS DOUBLE)"


def _gap_score(a: str, b: str, gap: str, pen: str) -> str:
    network = f"least(50.0, sqrt(least({a},{b}))*19.5e0+log10(1.0e0+{a}+{b})*12.0e0)"
    return _rounded(f"greatest(0.0, least(100.0, {network} + greatest(0.0,(1.0-{gap}/1200.0)*35.0) + least(15.0, greatest(0.3e0,1.8e0-{pen}*0.5e0)/1.3e0*15.0e0)))", 1)


def _kept(items: str, conflicts: str) -> str:
    """The ids that a pass over items(id) in id order keeps, as g_kept(id): conflicts(later, earlier) with a kept one drop an item."""
    return f"""g_seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS n, id, coalesce(prev, []) AS prev FROM {items} LEFT JOIN (SELECT later, list(earlier) AS prev FROM {conflicts} GROUP BY later) c ON later = id),
 g_pass(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT p.n + 1, CASE WHEN list_has_any(kept, prev) THEN kept ELSE list_append(kept, id) END FROM g_pass p JOIN g_seq s ON s.n = p.n + 1),
 g_kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g_pass ORDER BY n DESC LIMIT 1) l)"""


_LANES = "('track','lane','opposite_track','opposite_lane','share_busway','yes')"
_BASE = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in tags.HIGHWAY_PENALTY.items()) + f" ELSE {tags.OTHER_PENALTY}e0 END"
_RULE = f"""g_rule AS (SELECT *, CASE WHEN highway IN ('motorway') THEN 'blocked' WHEN access IN ('no','private') AND coalesce(bicycle,'') NOT IN ('yes','designated','permissive') THEN 'blocked'
 WHEN bicycle IN ('no','use_sidepath') THEN 'blocked' WHEN highway='cycleway' OR coalesce(cycleway,'')='track' OR coalesce(cycleway_right,'')='track' THEN 'dedicated_cycleway'
 WHEN coalesce(cycleway,'') IN {_LANES} OR coalesce(cycleway_right,'') IN {_LANES} OR bicycle='designated' THEN 'cycle_lane' WHEN base >= 1.8 THEN 'arterial_street' ELSE 'local_street' END AS category,
 round(CASE WHEN speed <= 30 THEN base*0.9e0 WHEN speed >= 60 THEN base+0.4e0 WHEN speed >= 50 THEN base+0.2e0 ELSE base END
 + CASE WHEN nlanes >= 4 THEN 0.5e0 WHEN nlanes >= 3 THEN 0.25e0 ELSE 0 END + CASE WHEN surface IN ('unpaved','gravel','ground','dirt','compacted') THEN 0.35e0 ELSE 0 END, 3) AS street_penalty,
 coalesce(oneway_bicycle,'')='no' OR coalesce(cycleway,'')='opposite_lane' OR coalesce(oneway,'')<>'-1' AS fwd,
 coalesce(oneway_bicycle,'')='no' OR coalesce(cycleway,'')='opposite_lane' OR coalesce(oneway,'')<>'yes' AS bwd
 FROM (SELECT *, {_BASE} AS base, try_cast(regexp_replace(maxspeed,'[^0-9.]','','g') AS DOUBLE) AS speed, try_cast(regexp_replace(lanes,'[^0-9]','','g') AS DOUBLE) AS nlanes FROM g_way) x)"""
_PEN = "CASE category WHEN 'blocked' THEN 'inf'::DOUBLE WHEN 'dedicated_cycleway' THEN CASE WHEN segregated='yes' THEN 0.7e0 ELSE 0.78e0 END WHEN 'cycle_lane' THEN 0.88e0 ELSE street_penalty END"
_EDGE = f"""{ctes("node", "position", "way")}, {_RULE}, g_seg AS (SELECT * FROM (SELECT way_id, pos, node AS u, lead(node) OVER (PARTITION BY way_id ORDER BY pos) AS v FROM g_position) s WHERE v IS NOT NULL),
 g_long AS (SELECT s.way_id, s.pos, s.u, s.v, r.category, {_PEN} AS penalty, coalesce(nullif(r.name,''),'Calle sin nombre') AS name, r.highway, fwd, bwd, {_hav("a.lon", "a.lat", "b.lon", "b.lat")} AS d
 FROM g_seg s JOIN g_rule r ON s.way_id=r.way_id AND r.category<>'blocked' JOIN g_node a ON a.id=s.u JOIN g_node b ON b.id=s.v),
 g_dir AS (SELECT u, v, 0 AS dir, way_id, pos, category, penalty, name, highway, d FROM g_long WHERE fwd AND d>=0.1 UNION ALL SELECT v, u, 1, way_id, pos, category, penalty, name, highway, d FROM g_long WHERE bwd AND d>=0.1),
 g_edge AS MATERIALIZED (SELECT u, v, round(d,2) AS length_m, round(d*penalty,2) AS cost, penalty AS penalty_factor, way_id, name, highway, category, category IN ('dedicated_cycleway','cycle_lane') AS is_cycling_infra
 FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY way_id DESC, pos DESC, dir DESC) AS n FROM g_dir) x WHERE n=1)"""
_FOLD = f"""{_EDGE}, g_fold AS (SELECT a, b, max(length_m) AS length_m, min_by(name, row(u,v)) AS name, min_by(category, row(u,v)) AS category FROM (SELECT *, least(u,v) AS a, greatest(u,v) AS b FROM g_edge WHERE is_cycling_infra) x GROUP BY a, b)"""
_CC = f"""{_FOLD}, g_both AS (SELECT a AS x, b AS y FROM g_fold UNION SELECT b, a FROM g_fold), g_reach(node, seen) AS (SELECT x, x FROM g_both UNION SELECT r.node, e.y FROM g_reach r JOIN g_both e ON r.seen=e.x),
 g_label AS (SELECT node, min(seen) AS component FROM g_reach GROUP BY node), g_deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g_fold UNION ALL SELECT b FROM g_fold) x GROUP BY node)"""
_COMP = f"""{_CC}, g_len AS (SELECT component, round(sum(length_m),1) AS length_m, round(sum(length_m)/1000,2) AS length_km FROM g_fold JOIN g_label ON node=a GROUP BY component),
 g_comp AS (SELECT row_number() OVER (ORDER BY count(*) DESC, l.component) AS id, l.component, count(*) AS node_count, any_value(g.length_m) AS length_m, any_value(g.length_km) AS length_km,
 min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(*) FILTER (degree=1) AS ends, min(l.node) AS least FROM g_label l JOIN g_deg d USING (node) JOIN g_node n ON n.id=l.node JOIN g_len g ON g.component=l.component GROUP BY l.component),
 g_end AS MATERIALIZED (SELECT c.id AS comp, c.length_km, l.node AS id FROM g_comp c JOIN g_label l USING (component) JOIN g_deg d USING (node) WHERE d.degree=1 UNION ALL SELECT id, length_km, least FROM g_comp WHERE ends=0)"""
_INFRA_NODES = "g_cyc AS (SELECT DISTINCT n.id, n.lon, n.lat FROM (SELECT u AS id FROM g_edge WHERE is_cycling_infra UNION SELECT v FROM g_edge WHERE is_cycling_infra) x JOIN g_node n USING (id))"


# --- building blocks -----------------------------------------------------------------------------------------------


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.directed_edges(fixture(spark, sf_dir, "position"), way_tags(spark, sf_dir), fixture(spark, sf_dir, "node"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(graph.cycling_edges(road_edges(spark, sf_dir)))


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_folded(spark, sf_dir), fixture(spark, sf_dir, "node"))


def _cycling_points(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    return graph.cycling_nodes(road_edges(spark, sf_dir) if edges is None else edges).withColumnRenamed("node", "id").join(fixture(spark, sf_dir, "node"), "id")


# --- graph building ------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGE} SELECT category, count(*) AS edges, round(sum(length_m),1) AS length_m, round(sum(cost),1) AS cost FROM g_edge GROUP BY category")
def edge_totals(spark, sf_dir):
    """Flagship: directed edges, length and cycling cost by category."""
    return road_edges(spark, sf_dir).groupBy("category").agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 1).alias("length_m"), F.round(F.sum("cost"), 1).alias("cost"))


@query(f"WITH {_EDGE} SELECT * FROM g_edge")
def edge_build(spark, sf_dir):
    return road_edges(spark, sf_dir).drop("infra_label", "surface", "maxspeed")


@query(f"""WITH {ctes("node", "position")}, p AS (SELECT way_id, pos, lon, lat, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM g_position JOIN g_node ON id=node WINDOW w AS (PARTITION BY way_id ORDER BY pos))
 SELECT way_id, count(*) AS points, round(sum(coalesce({_hav("lon0", "lat0", "lon", "lat")},0)),1) AS length_m FROM p GROUP BY way_id HAVING count(*) >= 2""")
def way_length(spark, sf_dir):
    p = fixture(spark, sf_dir, "position").withColumnRenamed("node", "nid")
    pos = p.join(fixture(spark, sf_dir, "node").withColumnRenamed("id", "nid"), "nid")
    lines = pos.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).filter(F.size("p") >= 2)
    coords = F.transform("p", lambda x: F.array(x["lon"], x["lat"]))
    return lines.select("way_id", F.size("p").cast("long").alias("points"), F.round(geo.line_length_m(coords), 1).alias("length_m"))


@query(f"""WITH {ctes("way")} SELECT way_id, CASE WHEN highway='cycleway' THEN 'dedicated' WHEN cycleway IS NOT NULL OR cycleway_right IS NOT NULL THEN 'on_street' WHEN bicycle='designated' THEN 'designated' ELSE 'compatible' END AS category,
 CASE WHEN highway='cycleway' AND segregated='yes' THEN 'Vía ciclista dedicada (segregada)' WHEN highway='cycleway' THEN 'Vía ciclista dedicada' WHEN cycleway_right='track' THEN 'Infraestructura ciclista sobre calle (segregada / track)'
 WHEN cycleway='lane' THEN 'Infraestructura ciclista sobre calle (ciclobanda / lane)' WHEN cycleway IS NOT NULL THEN 'Infraestructura ciclista sobre calle' WHEN bicycle='designated' THEN 'Vía designada / preferente para bicicleta' ELSE 'Infraestructura ciclista compatible' END AS label FROM g_way""")
def tag_classify(spark, sf_dir):
    return way_tags(spark, sf_dir).select("way_id", tags.classify_cycleway(F.col("tags")).alias("c")).select("way_id", "c.category", "c.label")


@query(f"WITH {ctes('way')}, {_RULE} SELECT way_id, category<>'blocked' AS is_cyclable, {_PEN} AS penalty, category FROM g_rule")
def edge_penalty(spark, sf_dir):
    return way_tags(spark, sf_dir).select("way_id", tags.cycling_cost(F.col("tags")).alias("c")).select("way_id", "c.is_cyclable", "c.penalty", "c.category")


@query(f"WITH {ctes('way')}, {_RULE} SELECT way_id, fwd AS forward, bwd AS backward FROM g_rule")
def oneway_rules(spark, sf_dir):
    return way_tags(spark, sf_dir).select("way_id", tags.directions(F.col("tags")).alias("d")).select("way_id", "d.forward", "d.backward")


@query(f"WITH {_FOLD} SELECT * FROM g_fold")
def undirected_fold(spark, sf_dir):
    return graph.cycling_edges(road_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_CC} SELECT degree, count(*) AS nodes FROM g_deg GROUP BY degree")
def endpoint_degree(spark, sf_dir):
    return graph.degrees(_folded(spark, sf_dir)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"WITH RECURSIVE {_COMP} SELECT id, component, node_count, length_m, length_km, CASE WHEN ends=0 THEN 1 ELSE ends END AS endpoints, min_lon, min_lat, max_lon, max_lat FROM g_comp")
def component_metrics(spark, sf_dir):
    c = _components(spark, sf_dir)
    return c.select(F.col("id").cast("long").alias("id"), "component", "node_count", "length_m", "length_km", F.size("endpoints").cast("long").alias("endpoints"), "bbox.*")


@query(f"WITH RECURSIVE {_COMP} SELECT f.a, f.b, f.length_m FROM g_fold f JOIN g_label l ON l.node=f.a WHERE l.component=(SELECT component FROM g_comp WHERE id=1)")
def largest_component(spark, sf_dir):
    return graph.largest_component(_folded(spark, sf_dir), "a", "b").select("a", "b", "length_m")


@query(f"WITH RECURSIVE {_COMP} SELECT count(*) AS components, count(*) FILTER (length_km < 1.0) AS isolated, round(sum(length_km),2) AS total_km, max(CASE WHEN id=1 THEN length_km END) AS main_km, least(100.0, round(max(CASE WHEN id=1 THEN length_km END)/greatest(sum(length_km),0.01)*100,1)) AS main_pct FROM g_comp")
def connectivity_stats(spark, sf_dir):
    main = F.max(F.when(F.col("id") == 1, F.col("length_km")))
    return _components(spark, sf_dir).agg(F.count("*").alias("components"), F.count_if(F.col("length_km") < 1.0).alias("isolated"), F.round(F.sum("length_km"), 2).alias("total_km"), main.alias("main_km"), scores.main_percent(main, F.sum("length_km")).alias("main_pct"))


#: Three cities, each a third of the lattice's rows; edges between them don't count.
_CITY = "g_city AS (SELECT id, 'c' || (CAST((id - id % 50) / 50 AS BIGINT) * 3 // (SELECT CAST(max((id - id % 50) / 50) AS BIGINT) + 1 FROM g_node)) AS city FROM g_node)"
_CITY_COMP = _COMP.replace(" g_fold AS (", f" {_CITY}, g_all AS (", 1).replace(", g_both AS (", ", g_fold AS (SELECT f.* FROM g_all f JOIN g_city x ON x.id=f.a JOIN g_city y ON y.id=f.b WHERE x.city=y.city), g_both AS (", 1)


def _city_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, nodes = F.floor((F.col("id") - F.col("id") % 50) / 50), fixture(spark, sf_dir, "node")
    return nodes.crossJoin(F.broadcast(nodes.agg((F.max(row) + 1).alias("rows")))).withColumn("city", F.concat(F.lit("c"), F.floor(row * 3 / F.col("rows")).cast("string"))).drop("rows")  # one row


def _city_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("city").alias(f"{c}_city"))
    return road_edges(spark, sf_dir).join(side("u"), "u").join(side("v"), "v").filter("u_city = v_city").drop("u_city", "v_city")


@query(f"WITH RECURSIVE {_CITY_COMP} SELECT city, row_number() OVER (PARTITION BY city ORDER BY node_count DESC, component) AS id, component, node_count, length_m FROM g_comp JOIN g_city ON g_city.id = component")
def city_components(spark, sf_dir):
    """Components of three cities by one plan, ranked in each."""
    nodes = _city_nodes(spark, sf_dir)
    return graph.components(cut(graph.cycling_edges(_city_edges(spark, sf_dir, nodes))), nodes, by=("city",)).select("city", "id", "component", "node_count", "length_m")


# --- spatial joins -------------------------------------------------------------------------------------------------


_ENDS = "g_ends AS (SELECT seq, 'o' AS which, o_lon AS lon, o_lat AS lat FROM g_request UNION ALL SELECT seq, 'd', d_lon, d_lat FROM g_request)"
_SNAP = f"{_ENDS}, g_snap AS (SELECT p.lon, p.lat, min({{'d': {_hav('p.lon', 'p.lat', 'n.lon', 'n.lat')}, 'id': n.id}}) AS s FROM (SELECT DISTINCT lon, lat FROM g_ends) p CROSS JOIN g_node n GROUP BY p.lon, p.lat)"


def _snapped(spark: SparkSession, sf_dir: str, most_m: float) -> DataFrame:
    """Both ends of every request (id: seq and which), with their node."""
    end = lambda x: F.struct(F.lit(x).alias("which"), F.col(f"{x}_lon").alias("lon"), F.col(f"{x}_lat").alias("lat"))
    ends = fixture(spark, sf_dir, "request").select("seq", F.explode(F.array(end("o"), end("d"))).alias("e")).select(F.struct("seq", "e.which").alias("id"), "e.lon", "e.lat")
    return routing.snap(ends, fixture(spark, sf_dir, "node"), COS_LAT, most_m)


@query(f"WITH {ctes('node', 'request')}, {_SNAP} SELECT seq, which, s.id AS node_id, round(s.d,3) AS snap_m, s.d > 15.0 AS out_of_bounds FROM g_ends JOIN g_snap USING (lon, lat)")
def snap_nearest(spark, sf_dir):
    """Both ends of every request."""
    return _snapped(spark, sf_dir, 15.0).select("id.seq", "id.which", "node_id", F.round("snap_m", 3).alias("snap_m"), "out_of_bounds")


_NEAR_CYC = f"EXISTS (SELECT 1 FROM g_cyc c WHERE {_planar('p.lon', 'p.lat', 'c.lon', 'c.lat')} <= 250.0)"
_VERY_NEAR_CYC = _NEAR_CYC.replace("250.0", "60.0")


@query(f"WITH {_EDGE}, {_INFRA_NODES}, {ctes('poi')} SELECT p.id, p.category FROM g_poi p WHERE {_NEAR_CYC}")
def radius_semi(spark, sf_dir):
    return spatial.radius_semi(fixture(spark, sf_dir, "poi"), _cycling_points(spark, sf_dir), 250.0, COS_LAT).select("id", "category")


@query(f"WITH {_EDGE}, {_INFRA_NODES}, {ctes('poi')} SELECT p.id, p.category FROM g_poi p WHERE NOT {_VERY_NEAR_CYC}")
def radius_anti(spark, sf_dir):
    return spatial.radius_semi(fixture(spark, sf_dir, "poi"), _cycling_points(spark, sf_dir), 60.0, COS_LAT, anti=True).select("id", "category")


@query(f"WITH {ctes('poi', 'node')} SELECT n.id, count(p.id) AS pois FROM g_node n LEFT JOIN g_poi p ON {_planar('n.lon', 'n.lat', 'p.lon', 'p.lat')} <= 349.0 GROUP BY n.id")
def radius_count(spark, sf_dir):
    return spatial.radius_count(fixture(spark, sf_dir, "node"), fixture(spark, sf_dir, "poi"), 349.0, COS_LAT, "pois").select("id", "pois")


_ACC = "g_acc AS (SELECT DISTINCT n.id, n.lon, n.lat FROM (SELECT u AS id FROM g_edge WHERE highway IN ('residential','living_street','service','unclassified','pedestrian','footway','track') UNION SELECT v FROM g_edge WHERE highway IN ('residential','living_street','service','unclassified','pedestrian','footway','track')) x JOIN g_node n USING (id))"
_BAND = "CASE WHEN d <= 250 THEN '0-250m' WHEN d <= 500 THEN '250-500m' WHEN d <= 1000 THEN '500-1000m' ELSE '>1000m' END"


@query(f"WITH {_EDGE}, {_INFRA_NODES}, {_ACC}, m AS (SELECT a.id, min({_planar('a.lon', 'a.lat', 'c.lon', 'c.lat')}) AS d FROM g_acc a CROSS JOIN g_cyc c GROUP BY a.id) SELECT {_BAND} AS band, count(*) AS nodes, round(avg(d),2) AS mean_m FROM m GROUP BY 1")
def distance_bands(spark, sf_dir):
    e = cut(road_edges(spark, sf_dir).select("u", "v", "highway", "is_cycling_infra"))
    acc = graph.access_nodes(e, tags.ACCESS_HIGHWAYS).withColumnRenamed("node", "id").join(fixture(spark, sf_dir, "node"), "id")
    d = spatial.nearest(acc, _cycling_points(spark, sf_dir, e), COS_LAT)
    return d.groupBy(scores.distance_band(F.col("near_m")).alias("band")).agg(F.count("*").alias("nodes"), F.round(F.avg("near_m"), 2).alias("mean_m"))


@query(f"""WITH RECURSIVE {_COMP}, e AS (SELECT g_end.id, comp, lon, lat FROM g_end JOIN g_node USING (id) WHERE length_km >= 0.2) SELECT x.id AS a, y.id AS b, x.comp AS comp_a, y.comp AS comp_b, round({_hav("x.lon", "x.lat", "y.lon", "y.lat")},1) AS crow_m
 FROM e x JOIN e y ON x.comp < y.comp AND {_hav("x.lon", "x.lat", "y.lon", "y.lat")} BETWEEN 35 AND 850""")
def endpoint_pairs(spark, sf_dir):
    ends = gaps.component_endpoints(_components(spark, sf_dir), fixture(spark, sf_dir, "node"))
    p = gaps.endpoint_pairs(ends, COS_LAT)
    return p.select("a", "b", F.col("comp_a").cast("long").alias("comp_a"), F.col("comp_b").cast("long").alias("comp_b"), F.round("crow_m", 1).alias("crow_m"))


# --- paths, gaps ---------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_EDGE}, s(query, node, dist) USING KEY (query, node) AS (SELECT id, id, 0.0::DOUBLE FROM g_node UNION SELECT x.query, x.node, x.dist FROM
 (SELECT s.query, e.v AS node, min(round(s.dist+e.length_m,6)) AS dist FROM s JOIN g_edge e ON e.u=s.node WHERE round(s.dist+e.length_m,6) <= 1200 GROUP BY s.query, e.v) x
 LEFT JOIN recurring.s o ON o.query=x.query AND o.node=x.node WHERE o.query IS NULL OR x.dist < o.dist) SELECT query, node, dist FROM s""")
def sssp_bounded(spark, sf_dir):
    """From every node, as far as the search for gaps looks."""
    e = road_edges(spark, sf_dir).select("u", "v", F.col("length_m").alias("w"))
    nodes = fixture(spark, sf_dir, "node")
    src = nodes.select(F.col("id").alias("query"), F.col("id").alias("node"))
    return bounded_paths(cut(e), src, 1200.0, paths=False, cells=lambda: node_cells(nodes, NEAR_NODES))


_GAPS = f"""{_COMP}, e AS (SELECT g_end.id, comp, length_km, lon, lat FROM g_end JOIN g_node USING (id) WHERE length_km >= 0.2),
 pr AS (SELECT * FROM (SELECT x.id AS a, y.id AS b, x.comp AS ca, y.comp AS cb, x.length_km AS akm, y.length_km AS bkm, {_hav("x.lon", "x.lat", "y.lon", "y.lat")} AS crow FROM e x JOIN e y ON x.comp < y.comp) p WHERE crow BETWEEN 35 AND 850),
 sp(query, node, dist, path) USING KEY (query, node) AS (SELECT DISTINCT a, a, 0.0::DOUBLE, [a] FROM pr UNION SELECT x.query, x.node, x.m.dist, x.m.path FROM
 (SELECT s.query, ed.v AS node, min({{'dist': round(s.dist+ed.length_m,6), 'path': list_append(s.path, ed.v)}}) AS m FROM sp s JOIN g_edge ed ON ed.u=s.node WHERE round(s.dist+ed.length_m,6) <= 1200 GROUP BY s.query, ed.v) x
 LEFT JOIN recurring.sp o ON o.query=x.query AND o.node=x.node WHERE o.query IS NULL OR x.m < {{'dist': o.dist, 'path': o.path}}),
 cand AS (SELECT pr.*, dist AS gap, path FROM pr JOIN sp ON query=a AND node=b WHERE dist <= crow*2.2),
 hop AS (SELECT a, b, i, g.name, g.highway, coalesce(g.penalty_factor, 1.0) AS pen FROM (SELECT a, b, path, unnest(range(1, len(path))) AS i FROM cand) c LEFT JOIN g_edge g ON g.u=path[i] AND g.v=path[i+1]),
 per AS (SELECT a, b, avg(pen) AS pen, list(name ORDER BY i) AS names, list(highway ORDER BY i) AS kinds FROM hop GROUP BY a, b),
 scored AS (SELECT *, {_gap_score("akm", "bkm", "gap", "pen")} AS score FROM cand JOIN per USING (a, b)),
 best AS (SELECT row_number() OVER (ORDER BY score DESC, ca, cb) AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY ca, cb ORDER BY score DESC, a, b) AS n FROM scored) x WHERE n = 1),
 conf AS (SELECT l.id AS later, r.id AS earlier FROM best l JOIN best r ON l.id > r.id WHERE len(list_intersect(list_distinct(l.path), list_distinct(r.path))) > least(len(list_distinct(l.path)), len(list_distinct(r.path))) * 0.6e0),
 {_kept("best", "conf")}, gap AS (SELECT row_number() OVER (ORDER BY id) AS rank, *, list_filter(names, lambda x: x IS NOT NULL AND x <> '') AS nn FROM best JOIN g_kept USING (id)),
 street AS (SELECT *, list_filter(nn, lambda x, i: i = 1 OR x <> nn[i-1]) AS streets FROM gap WHERE rank <= 10)"""


@query(f"""WITH RECURSIVE {_GAPS} SELECT rank, ca AS comp_a_id, cb AS comp_b_id, akm AS comp_a_km, bkm AS comp_b_km, a AS node_origin, b AS node_dest, {_rounded("gap", 1)} AS gap_length_m, {_rounded("crow", 1)} AS crow_distance_m,
 {_rounded("akm+bkm", 2)} AS connected_network_km, {_rounded("least(akm,bkm)", 2)} AS network_gain_km, {_rounded("least(akm,bkm)/(gap/1000.0)", 1)} AS gain_ratio, score AS priority_score, array_to_string(streets, '|') AS streets,
 array_to_string(list_sort(list_distinct(list_filter(kinds, lambda x: x <> ''))), '|') AS highway_types, {_rounded("pen", 2)} AS avg_penalty, array_to_string(path, ',') AS path_nodes FROM street""")
def gap_rank(spark, sf_dir):
    g = _ranked_gaps(spark, sf_dir)
    joined = {"streets": F.array_join("streets", "|"), "highway_types": F.array_join(F.array_sort("highway_types"), "|"), "path_nodes": F.array_join(F.col("path_nodes").cast("array<string>"), ",")}
    return g.withColumns(joined).withColumns({c: F.col(c).cast("long") for c in ("rank", "comp_a_id", "comp_b_id")}).drop("coordinates")


def _ranked_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = cut(road_edges(spark, sf_dir)), fixture(spark, sf_dir, "node")
    comps = cut(graph.components(graph.cycling_edges(e), n))
    return gaps.rank_gaps(cut(gaps.gap_candidates(e, n, comps, COS_LAT)), 10)


#: The gaps of three cities at once: edges between cities don't count, so no path joins components of two.
_CITY_GAPS = _GAPS.replace(" g_edge AS MATERIALIZED (", f" {_CITY}, g_every AS MATERIALIZED (", 1).replace(", g_fold AS (", ", g_edge AS MATERIALIZED (SELECT e.* FROM g_every e JOIN g_city x ON x.id=e.u JOIN g_city y ON y.id=e.v WHERE x.city=y.city), g_fold AS (", 1)


@query(f"""WITH RECURSIVE {_CITY_GAPS} SELECT * FROM (SELECT city, row_number() OVER (PARTITION BY city ORDER BY gap.id) AS rank, a AS node_origin, b AS node_dest, score AS priority_score, {_rounded("gap", 1)} AS gap_length_m, array_to_string(path, ',') AS path_nodes
 FROM gap JOIN g_city ON g_city.id = gap.a) x WHERE rank <= 10""")
def city_gaps(spark, sf_dir):
    """The ranked gaps of three cities by one plan."""
    n = _city_nodes(spark, sf_dir).withColumn("cos_lat", F.lit(COS_LAT))
    e = cut(_city_edges(spark, sf_dir, n))
    comps = cut(graph.components(graph.cycling_edges(e), n, by=("city",)))
    g = gaps.rank_gaps(cut(gaps.gap_candidates(e, n, comps, "cos_lat", by=("city",))), 10, ("city",))
    return g.select("city", "rank", "node_origin", "node_dest", "priority_score", "gap_length_m", F.array_join(F.col("path_nodes").cast("array<string>"), ",").alias("path_nodes"))


@query(f"""WITH RECURSIVE {_GAPS} SELECT printf('gap-lattice-%02d', rank) AS id, concat('Oportunidad #', printf('%02d', rank), ': ', coalesce(streets[1], 'Conexión barrial')) AS name, rank, score AS priority_score, CAST(trunc({_rounded("gap", 1)}) AS INT) AS gap_length_m,
 CASE WHEN len(streets) > 0 THEN array_to_string(streets[1:3], ', ') ELSE 'Vías urbanas' END AS streets_display, len(path) AS points FROM street""")
def geojson_feature(spark, sf_dir):
    """Features of the ranked gaps: what the layer shows, with the number of points of each line."""
    f = gaps.gap_features(_ranked_gaps(spark, sf_dir), F.lit("lattice"))
    return f.select("id", "name", F.col("rank").cast("long").alias("rank"), "priority_score", "gap_length_m", "streets_display", F.size("coordinates").cast("long").alias("points"))


@query("""WITH p AS (SELECT o_orderkey AS id, (o_custkey % 90) / 4.0 + 0.2 AS a, (o_orderkey % 130) / 5.0 + 0.2 AS b, CAST(o_orderkey % 1300 AS DOUBLE) AS gap, 0.7 + (o_orderkey % 30) / 10.0 AS pen FROM orders)
 SELECT id, """ + _gap_score("a", "b", "gap", "pen") + """ AS score,
 round(a+b,2) AS connected_network_km, round(least(a,b),2) AS network_gain_km, CASE WHEN gap > 0 THEN round(least(a,b)/(gap/1000.0),1) ELSE 0.0 END AS gain_ratio FROM (SELECT id, a::DOUBLE AS a, b::DOUBLE AS b, gap, pen::DOUBLE AS pen FROM p) q""")
def gap_score(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    p = o.select(k.alias("id"), (F.col("o_custkey") % 90 / 4 + 0.2).alias("a"), (k % 130 / 5 + 0.2).alias("b"), (k % 1300).cast("double").alias("gap"), (k % 30 / 10 + 0.7).alias("pen"))
    g = scores.gap_gain(F.col("a"), F.col("b"), F.col("gap"))
    return p.select("id", scores.gap_priority(F.col("a"), F.col("b"), F.col("gap"), F.col("pen")).alias("score"), g["connected_network_km"].alias("connected_network_km"), g["network_gain_km"].alias("network_gain_km"), g["gain_ratio"].alias("gain_ratio"))


@query("""WITH p AS (SELECT o_custkey % 40 AS a, 40 + o_orderkey % 40 AS b, o_orderkey AS k, (o_orderkey * 31) % 1000 / 10.0 AS score FROM orders)
 SELECT a AS comp_a_id, b AS comp_b_id, k AS node_origin, CAST(score AS DOUBLE) AS priority_score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, k) AS n FROM p) x WHERE n=1""")
def pair_best(spark, sf_dir):
    k = F.col("o_orderkey")
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 40).alias("comp_a_id"), (k % 40 + 40).alias("comp_b_id"), k.alias("node_origin"), k.alias("node_dest"), (k * 31 % 1000 / 10).alias("priority_score"))
    return gaps.best_of_pairs(p).drop("node_dest")


@query(f"""WITH RECURSIVE {_EDGE}, {ctes("request")}, {_SNAP}, pair AS (SELECT DISTINCT o.s.id AS src, d.s.id AS dst FROM g_request r JOIN g_snap o ON o.lon=r.o_lon AND o.lat=r.o_lat JOIN g_snap d ON d.lon=r.d_lon AND d.lat=r.d_lat WHERE o.s.d <= 500 AND d.s.d <= 500),
 w AS MATERIALIZED (SELECT u, v, 'cost' AS weight, cost AS w FROM g_edge UNION ALL SELECT u, v, 'length_m', length_m FROM g_edge),
 sp(weight, query, node, dist) USING KEY (weight, query, node) AS (SELECT DISTINCT weight, src, src, 0.0::DOUBLE FROM pair, (SELECT DISTINCT weight FROM w) k UNION SELECT x.weight, x.query, x.node, x.dist FROM
 (SELECT s.weight, s.query, w.v AS node, min(s.dist+w.w) AS dist FROM sp s JOIN w ON w.u=s.node AND w.weight=s.weight GROUP BY s.weight, s.query, w.v) x LEFT JOIN recurring.sp o ON o.weight=x.weight AND o.query=x.query AND o.node=x.node WHERE o.query IS NULL OR x.dist < o.dist)
 SELECT src, dst, weight, round(dist,2) AS total FROM pair JOIN sp ON query=src AND node=dst""")
def route_totals(spark, sf_dir):
    """Least cost and least length of every request's pair of snapped nodes."""
    both = _snapped(spark, sf_dir, 500.0).filter("not out_of_bounds").groupBy("id.seq").agg(*(F.max(F.when(F.col("id.which") == x, F.col("node_id"))).alias(c) for x, c in (("o", "src"), ("d", "dst"))))
    pairs = both.filter("src is not null and dst is not null").select("src", "dst")
    return routing.shortest_routes(pairs, cut(road_edges(spark, sf_dir)), ("cost", "length_m")).select("src", "dst", "weight", F.round("total", 2).alias("total"))


_PAIRS = """pair AS (SELECT DISTINCT o.s.id AS src, d.s.id AS dst FROM g_request r JOIN g_snap o ON o.lon=r.o_lon AND o.lat=r.o_lat JOIN g_snap d ON d.lon=r.d_lon AND d.lat=r.d_lat WHERE o.s.d <= 500 AND d.s.d <= 500),
 w AS MATERIALIZED (SELECT u, v, 'cost' AS weight, cost AS w FROM g_edge UNION ALL SELECT u, v, 'length_m', length_m FROM g_edge),
 sp(weight, query, node, dist) USING KEY (weight, query, node) AS (SELECT DISTINCT weight, src, src, 0.0::DOUBLE FROM pair, (SELECT DISTINCT weight FROM w) k UNION SELECT x.weight, x.query, x.node, x.dist FROM
 (SELECT s.weight, s.query, w.v AS node, min(s.dist+w.w) AS dist FROM sp s JOIN w ON w.u=s.node AND w.weight=s.weight GROUP BY s.weight, s.query, w.v) x LEFT JOIN recurring.sp o ON o.weight=x.weight AND o.query=x.query AND o.node=x.node WHERE o.query IS NULL OR x.dist < o.dist)"""
#: Each route back from its end, over the smallest node that a shortest way comes from, and what is summed along it.
_ROUTE = f"""{_PAIRS}, prev AS MATERIALIZED (SELECT a.weight, a.query, w.v AS node, min(w.u) AS prev FROM sp a JOIN w ON w.u=a.node AND w.weight=a.weight JOIN sp b ON b.weight=a.weight AND b.query=a.query AND b.node=w.v AND b.dist=a.dist+w.w WHERE w.v <> a.query GROUP BY ALL),
 back(weight, src, dst, node, prev) AS (SELECT p.weight, src, dst, p.node, p.prev FROM pair JOIN prev p ON p.query=src AND p.node=dst UNION ALL SELECT b.weight, b.src, b.dst, p.node, p.prev FROM back b JOIN prev p ON p.weight=b.weight AND p.query=b.src AND p.node=b.prev),
 total AS (SELECT b.weight, b.src, b.dst, round(sum(e.length_m),6) AS m, round(sum(e.cost),6) AS cost FROM back b JOIN g_edge e ON e.u=b.prev AND e.v=b.node GROUP BY ALL UNION ALL SELECT weight, src, dst, 0.0, 0.0 FROM pair, (SELECT DISTINCT weight FROM w) k WHERE src=dst),
 route AS (SELECT c.src, c.dst, {_rounded("c.m", 1)} AS cycling_m, {_rounded("s.m", 1)} AS shortest_m, {_rounded("c.cost", 1)} AS cost_score FROM total c JOIN total s USING (src, dst) WHERE c.weight='cost' AND s.weight='length_m')"""


@query(f"""WITH RECURSIVE {_EDGE}, {ctes("request")}, {_SNAP}, {_ROUTE}
 SELECT r.seq AS id, o.s.id AS src, d.s.id AS dst, cycling_m, shortest_m, cost_score, CASE WHEN shortest_m > 0 THEN {_rounded("(cycling_m - shortest_m) / shortest_m * 100.0e0", 1)} WHEN shortest_m IS NOT NULL THEN 0.0 END AS length_diff_pct,
 CASE WHEN o.s.d > 500 OR d.s.d > 500 THEN 'out_of_bounds' WHEN cycling_m IS NULL THEN 'no_route' END AS error FROM g_request r JOIN g_snap o ON o.lon=r.o_lon AND o.lat=r.o_lat JOIN g_snap d ON d.lon=r.d_lon AND d.lat=r.d_lat LEFT JOIN route x ON x.src=o.s.id AND x.dst=d.s.id""")
def route_compare(spark, sf_dir):
    r = fixture(spark, sf_dir, "request").withColumnRenamed("seq", "id")
    out = routing.route_batch(r, fixture(spark, sf_dir, "node"), cut(road_edges(spark, sf_dir)), COS_LAT)
    return out.select("id", "src", "dst", F.col("cycling.distance_m").alias("cycling_m"), F.col("shortest.distance_m").alias("shortest_m"), F.col("cycling.cost_score").alias("cost_score"), "comparison.length_diff_pct", "error")


_RUN = "SELECT way_id % 100 AS g, way_id, name FROM g_way"


@query(f"""WITH {ctes("way")}, p AS ({_RUN}), q AS (SELECT g, way_id, name FROM p WHERE name IS NOT NULL AND name <> ''), r AS (SELECT g, way_id, name, lag(name) OVER (PARTITION BY g ORDER BY way_id) AS prev FROM q)
 SELECT g, string_agg(name, '|' ORDER BY way_id) AS streets FROM r WHERE prev IS NULL OR prev <> name GROUP BY g""")
def street_runs(spark, sf_dir):
    w = fixture(spark, sf_dir, "way").select((F.col("way_id") % 100).alias("g"), "way_id", "name")
    runs = groups.runs(w, ["g"], ["way_id"], "name").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("way_id", "name"))).alias("s"))
    return runs.select("g", F.array_join(F.col("s.name"), "|").alias("streets"))


@query(f"""WITH {ctes("way")}, p AS ({_RUN}), q AS (SELECT g, name, min(way_id) AS k FROM p WHERE name IS NOT NULL GROUP BY g, name), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS n FROM q)
 SELECT g, string_agg(name, '|' ORDER BY k) AS streets FROM r WHERE n <= 4 GROUP BY g""")
def ordered_distinct(spark, sf_dir):
    w = fixture(spark, sf_dir, "way").groupBy((F.col("way_id") % 100).alias("g")).agg(F.array_sort(F.collect_list(F.struct("way_id", "name"))).alias("s"))
    named = F.filter(F.transform("s", lambda x: x["name"]), lambda x: x.isNotNull())
    return w.select("g", F.array_join(F.slice(F.array_distinct(named), 1, 4), "|").alias("streets"))


# --- clustering, places --------------------------------------------------------------------------------------------

#: The lattice, drawn together towards the middle of each 12 x 12 square, so that density varies and clusters are apart.
_PTS = """pts AS (SELECT id, round(lon - 0.0011e0 * (x % 12 - 5.5e0) * CASE WHEN x % 12 BETWEEN 2 AND 9 AND y % 12 BETWEEN 2 AND 9 THEN 0.6e0 ELSE -0.35e0 END, 6) AS lon,
 round(lat - 0.0009e0 * (y % 12 - 5.5e0) * CASE WHEN x % 12 BETWEEN 2 AND 9 AND y % 12 BETWEEN 2 AND 9 THEN 0.6e0 ELSE -0.35e0 END, 6) AS lat
 FROM (SELECT *, id % 50 AS x, CAST((id - id % 50) / 50 AS BIGINT) AS y FROM g_node) q)"""
_NB = f"nb AS MATERIALIZED (SELECT a.id, b.id AS other FROM pts a JOIN pts b ON {_planar('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 300.0), core AS (SELECT id FROM nb GROUP BY id HAVING count(*) >= 20)"
_DB = f"""{_PTS}, {_NB}, cc(id, other) AS (SELECT id, id FROM core UNION SELECT c.id, n.other FROM cc c JOIN nb n ON n.id=c.other JOIN core k ON k.id=n.other), lab AS (SELECT id, min(other) AS cluster FROM cc GROUP BY id),
 reach AS (SELECT l.cluster, l.id AS core, n.other FROM lab l JOIN nb n ON n.id=l.id WHERE n.other NOT IN (SELECT id FROM core)),
 mem AS (SELECT cluster, id, TRUE AS is_core FROM lab UNION ALL SELECT cluster, id, FALSE FROM (SELECT cluster, other AS id FROM reach WHERE core=cluster UNION SELECT min(cluster), other FROM reach WHERE other > cluster GROUP BY other) b)"""


def _cluster_points(spark, sf_dir):
    return spark.sql(f"WITH {_PTS} SELECT * FROM pts".replace("FROM g_node", "FROM {g_node}"), g_node=fixture(spark, sf_dir, "node"))


@query(f"WITH RECURSIVE {ctes('node')}, {_DB} SELECT cluster, id, is_core FROM mem")
def dbscan(spark, sf_dir):
    return cluster.dbscan(_cluster_points(spark, sf_dir), COS_LAT)


@query(f"""WITH RECURSIVE {ctes("node")}, {_DB}, d AS (SELECT m.cluster, p.lon, p.lat, (m.id % 1000) + 0.5 AS dist FROM mem m JOIN pts p USING (id))
 SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) AS rank, count(*) AS node_count, round(avg(lon),5) AS mean_lon, round(avg(lat),5) AS mean_lat, round(max(dist),1)::DOUBLE AS max_m, round(count(*)*(avg(dist)/500.0e0+1.0e0)+12.0e0*(cluster % 5),1) AS need FROM d GROUP BY cluster""")
def cluster_stats(spark, sf_dir):
    pts = _cluster_points(spark, sf_dir).withColumn("dist", F.col("id") % 1000 + F.lit(0.5).cast("double"))
    s = cluster.cluster_summary(cluster.dbscan(pts, COS_LAT), pts)
    return s.select("cluster", F.col("rank").cast("long").alias("rank"), "node_count", F.round("mean_lon", 5).alias("mean_lon"), F.round("mean_lat", 5).alias("mean_lat"), F.round("max_m", 1).alias("max_m"), scores.need_score(F.col("node_count"), F.col("mean_m"), F.col("cluster") % 5).alias("need"))


@query()
def expansion_plan(spark, sf_dir):
    """Up to six phases over the whole lattice, whose cycling infrastructure counts in its southern quarter only."""
    from rodada.operators.expansion import plan_expansion

    nodes, edges = fixture(spark, sf_dir, "node"), road_edges(spark, sf_dir)
    quarter = nodes.agg((F.min("lat") * 3 + F.max("lat")).alias("lat4"))
    served = nodes.crossJoin(F.broadcast(quarter)).filter(F.col("lat") * 4 <= F.col("lat4")).select(F.col("id").alias("u"), F.lit(True).alias("served"))
    edges = edges.join(served, "u", "left").withColumn("is_cycling_infra", F.col("is_cycling_infra") & F.col("served").isNotNull()).drop("served")
    plan = plan_expansion("lattice", nodes, edges, fixture(spark, sf_dir, "poi"), COS_LAT)
    names = ("phase", "phase_id", "sector", "alt_type", "expansion_type", "urban_context", "length_m", "length_km", "new_nodes", "new_pois", "total_score", "cum_km", "cum_nodes", "cum_pois")
    return plan.select(*names) if plan is not None else spark.createDataFrame([], "phase int, phase_id string, sector string, alt_type string, expansion_type string, urban_context string, length_m double, length_km double, new_nodes long, new_pois long, total_score double, cum_km double, cum_nodes long, cum_pois long")


_NAMED = "l.norm NOT IN ('', 'sin nombre') AND l.category = r.category AND (contains(r.norm, l.norm) OR contains(l.norm, r.norm))"


@query(f"""WITH RECURSIVE {ctes("poi")}, p AS (SELECT *, lower(name) AS norm FROM g_poi), conf AS (SELECT l.id AS later, r.id AS earlier FROM p l JOIN p r ON l.id > r.id AND {_planar("l.lon", "l.lat", "r.lon", "r.lat")} < 150 WHERE {_planar("l.lon", "l.lat", "r.lon", "r.lat")} < 15 OR ({_NAMED})),
 {_kept("g_poi", "conf")} SELECT g_poi.* FROM g_poi JOIN g_kept USING (id)""")
def poi_dedup(spark, sf_dir):
    return pois.deduplicate_pois(fixture(spark, sf_dir, "poi"), COS_LAT)


@query(f"""WITH RECURSIVE {_EDGE}, {_INFRA_NODES}, conf AS (SELECT l.id AS later, r.id AS earlier FROM g_cyc l JOIN g_cyc r ON l.id > r.id AND {_planar("l.lon", "l.lat", "r.lon", "r.lat")} < 140), {_kept("g_cyc", "conf")} SELECT id FROM g_kept""")
def origin_thinning(spark, sf_dir):
    c = cut(_cycling_points(spark, sf_dir))
    near = spatial.radius_pairs(c, c, 140.0, COS_LAT, strict=True).filter("l_id > r_id").select(F.col("l_id").alias("later"), F.col("r_id").alias("earlier"))
    return first_fit(c.select("id"), near)


_AM = "['school','hospital','marketplace','police','cafe','','doctors','university']"


@query(f"""WITH t AS (SELECT o_orderkey AS id, list_extract({_AM}, CAST(o_orderkey % 8 AS INT)+1) AS amenity, CASE WHEN o_orderkey % 9 = 0 THEN 'park' ELSE '' END AS leisure, CASE WHEN o_orderkey % 10 = 0 THEN 'mall' ELSE '' END AS shop, CASE WHEN o_orderkey % 12 = 0 THEN 'station' ELSE '' END AS railway FROM orders)
 SELECT id, CASE WHEN amenity IN ('school','university') THEN 'education' WHEN amenity IN ('hospital','doctors') THEN 'healthcare' WHEN shop='mall' OR amenity='marketplace' THEN 'commercial' WHEN leisure='park' THEN 'parks_leisure' WHEN amenity='police' OR railway='station' THEN 'public_services' ELSE 'other' END AS category,
 CASE WHEN amenity IN ('school','university','hospital','doctors') THEN amenity WHEN shop='mall' OR amenity='marketplace' THEN coalesce(nullif(shop,''),amenity) WHEN leisure='park' THEN leisure WHEN amenity='police' OR railway='station' THEN coalesce(nullif(amenity,''),railway) ELSE coalesce(nullif(amenity,''),nullif(leisure,''),shop) END AS subcategory FROM t""")
def poi_categorise(spark, sf_dir):
    k = F.col("o_orderkey")
    amenity = F.element_at(F.array(*(F.lit(x) for x in ("school", "hospital", "marketplace", "police", "cafe", "", "doctors", "university"))), (k % 8).cast("int") + 1)
    pick = lambda m, v: F.when(k % m == 0, v).otherwise("")
    m = F.create_map(F.lit("amenity"), amenity, F.lit("leisure"), pick(9, "park"), F.lit("shop"), pick(10, "mall"), F.lit("railway"), pick(12, "station"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), text.poi_category(m).alias("c")).select("id", "c.category", "c.subcategory")


@query(r"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents) x")
def text_normalise(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalized(F.col("text")).alias("n"))
    return d.select("doc_id", F.length("n").cast("long").alias("n_chars"), F.md5("n").alias("digest"))


# --- planning formulas ---------------------------------------------------------------------------------------------


@query(f"""WITH {_EDGE} SELECT u, v, round(length_m*CASE WHEN is_cycling_infra THEN 0.5e0 ELSE 1 END,3) AS direct, round(length_m*CASE WHEN is_cycling_infra THEN 0.5e0 WHEN highway IN ('secondary','secondary_link') THEN 0.6e0 WHEN highway IN ('tertiary','tertiary_link') THEN 0.7e0 WHEN highway IN ('residential','living_street') THEN 1.25e0 ELSE 1.5e0 END,3) AS structural FROM g_edge""")
def corridor_costs(spark, sf_dir):
    c = scores.corridor_costs(F.col("length_m"), F.col("highway"), F.col("is_cycling_infra"))
    return road_edges(spark, sf_dir).select("u", "v", F.round(c["direct"], 3).alias("direct"), F.round(c["structural"], 3).alias("structural"))


@query("""SELECT o_orderkey AS id, CASE WHEN tr >= 0.35 OR (len > 1800 AND p <= 3) OR (o_orderkey % 5 = 0 AND p <= 2) THEN 'periurban' WHEN p >= 4 OR tr <= 0.15 THEN 'urban' ELSE 'uncertain' END AS context
 FROM (SELECT o_orderkey, (o_orderkey % 41) / 100.0 AS tr, o_orderkey % 3500 AS len, o_custkey % 7 AS p FROM orders) x""")
def urban_context(spark, sf_dir):
    k = F.col("o_orderkey")
    street = F.when(k % 5 == 0, "Camino Real").otherwise("Avenida")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), scores.urban_context(k % 41 / 100, k % 3500, F.col("o_custkey") % 7, street).alias("context"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS base, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n, o_orderkey % 7 < 3 AS s, (o_orderkey % 61) / 100.0 AS axis FROM orders),
 y AS (SELECT *, CASE WHEN n=0 THEN CASE WHEN s THEN 'trunk_extension' ELSE 'branch' END WHEN base OR n>=2 THEN 'cross_connector' WHEN s THEN 'trunk_extension' ELSE 'continuation' END AS role FROM x)
 SELECT id, role, n AS phases, CAST(CASE WHEN n=0 THEN 6.0 ELSE 5.0 END + CASE role WHEN 'cross_connector' THEN 5.0 WHEN 'continuation' THEN 4.5 WHEN 'trunk_extension' THEN 4.0 ELSE 2.5 END + CASE WHEN s OR axis >= 0.3 THEN 4.0 ELSE 2.5 END + CASE WHEN id % 4 = 0 THEN 3.0 WHEN role='trunk_extension' THEN 2.0 ELSE 1.5 END AS DOUBLE) AS continuity FROM y""")
def topology_type(spark, sf_dir):
    k = F.col("o_orderkey")
    sources = F.array_compact(F.array(F.when(k % 2 == 0, "base"), F.when(k % 3 == 0, "expansion-x-01"), F.when(k % 5 == 0, "expansion-x-02")))
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), sources.alias("s"), (k % 7 < 3).alias("st"), (k % 61 / 100).alias("axis"), F.when(k % 4 == 0, "urban").otherwise("uncertain").alias("ctx"))
    y = x.withColumn("role", scores.topology_type(F.col("s"), F.col("st"))).withColumn("phases", F.size(scores.dependencies(F.col("s"))))
    return y.select("id", "role", "phases", scores.continuity_score(F.col("role"), F.col("phases"), F.col("st"), F.col("axis"), F.col("ctx")).alias("continuity"))


@query("""WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 400 + 1 AS DOUBLE) AS nn, CAST(o_orderkey % 12 AS DOUBLE) AS np, (o_orderkey % 400 + 1) * 1000.0e0 / (10.1e0 + (o_orderkey % 50) * 1.8e0) AS len, 12.5e0 AS cont, 5.0e0 + (o_orderkey % 51) / 10.0e0 AS ax FROM orders),
 y AS (SELECT *, round(nn/greatest(len/1000.0e0,0.1e0),1) AS eff FROM x)
 SELECT id, round(least(35.0, nn/250.0e0*35.0e0),1) AS s_cov, round(least(25.0, np/8.0e0*25.0e0),1) AS s_poi, round(least(10.0, eff/180.0e0*10.0e0),1) AS s_eff, round(least(35.0, nn/250.0e0*35.0e0)+least(25.0, np/8.0e0*25.0e0)+cont+ax+least(10.0, eff/180.0e0*10.0e0),1) AS total_score FROM y""")
def expansion_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    x = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), (k % 400 + 1).cast("double").alias("nn"), (k % 12).cast("double").alias("np"), ((k % 400 + 1) * 1000.0 / (k % 50 * 1.8 + 10.1)).alias("len"), (k % 51 / 10 + 5.0).alias("ax"))
    return x.select("id", scores.expansion_scores(F.col("nn"), F.col("np"), F.col("len"), F.lit(12.5), F.col("ax")).alias("s")).select("id", "s.*")


_PHASE = "SELECT n_regionkey AS city, n_nationkey AS phase, round(0.5e0 + (n_nationkey * 37 % 100) / 100.0e0, 2) AS km, n_nationkey * 13 % 200 AS nodes, n_nationkey % 9 AS pois FROM nation"


@query(f"WITH p AS ({_PHASE}) SELECT city, phase, round(sum(km) OVER w,2) AS cum_km, CAST(sum(nodes) OVER w AS BIGINT) AS cum_nodes, CAST(sum(pois) OVER w AS BIGINT) AS cum_pois FROM p WINDOW w AS (PARTITION BY city ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def phase_running_totals(spark, sf_dir):
    p = spark.sql(_PHASE.replace("FROM nation", "FROM {nation}"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return running_totals(p)


def running_totals(phases: DataFrame) -> DataFrame:
    """Cumulative km, nodes and pois of each city's phases."""
    w = Window.partitionBy("city").orderBy("phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return phases.select("city", "phase", F.round(F.sum("km").over(w), 2).alias("cum_km"), F.sum("nodes").over(w).alias("cum_nodes"), F.sum("pois").over(w).alias("cum_pois"))


@query(f"WITH {_EDGE} SELECT category, CAST(trunc(list_extract(list_sort(list(length_m)), CAST(floor(count(*)/2) AS INT)+1)) AS INT) AS median_m FROM g_edge GROUP BY category")
def upper_median(spark, sf_dir):
    return groups.upper_medians(road_edges(spark, sf_dir), ["category"], "length_m", "median_m")


@query(f"WITH {ctes('position')} SELECT way_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM (SELECT way_id, pos, row_number() OVER (PARTITION BY way_id ORDER BY pos) - 1 AS k FROM g_position) x WHERE k % 3 = 0 GROUP BY way_id")
def stride_sample(spark, sf_dir):
    return groups.every_nth(fixture(spark, sf_dir, "position"), ["way_id"], ["pos"], 3).groupBy("way_id").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("SELECT user_id AS target, event_id AS origin, value AS dist FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) x WHERE n <= 2")
def topk_per_group(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("target"), F.col("event_id").alias("origin"), F.col("value").alias("dist"))
    return groups.best_per_group(e, ["target"], ["dist", "origin"], 2)


@query(f"WITH {ctes('way')} SELECT g, name, c AS n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, name) AS k FROM (SELECT way_id % 100 AS g, name, count(*) AS c FROM g_way WHERE name IS NOT NULL GROUP BY 1, 2) x) y WHERE k=1")
def mode_street(spark, sf_dir):
    return groups.most_frequent(fixture(spark, sf_dir, "way").select((F.col("way_id") % 100).alias("g"), "name"), ["g"], "name", "n")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


# --- catalogue, cache ----------------------------------------------------------------------------------------------


@query("SELECT r_regionkey AS id, r_name AS name, coalesce(nullif(n_name, ''), 'Ciudad ' || r_name) AS description, n_nationkey AS stats, n_regionkey AS connectivity FROM region LEFT JOIN nation ON n_nationkey = r_regionkey")
def catalog_left_join(spark, sf_dir):
    """Registry rows (regions) with what the cities' documents (nations) add."""
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    registry = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("Ciudad "), "r_name").alias("description"))
    return catalog.cities(registry, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("description"), F.col("n_nationkey").alias("stats"), F.col("n_regionkey").alias("connectivity")))


@query("SELECT n_regionkey AS city, count(*) AS layers FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) GROUP BY n_regionkey")
def layer_semi_join(spark, sf_dir):
    n, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier"))
    layers = n.select(F.col("n_regionkey").alias("city"), F.col("n_nationkey").alias("layer"))
    return catalog.with_files(layers, s.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("layer")), ["layer"]).groupBy("city").agg(F.count("*").alias("layers"))


#: The requests in order, with the keys that the cache holds before each: at 1000 keys a store drops the oldest one first.
_CACHE = """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS n, seq, profile, dense_rank() OVER (ORDER BY o_lon, o_lat, d_lon, d_lat) AS key FROM g_request),
 walk(n, held) AS (SELECT CAST(1 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT w.n + 1, CASE WHEN k.profile = 'balanced' AND list_contains(held, k.key) THEN held WHEN list_contains(CASE WHEN len(held) >= 1000 THEN held[2:] ELSE held END, k.key) THEN CASE WHEN len(held) >= 1000 THEN held[2:] ELSE held END
 ELSE list_append(CASE WHEN len(held) >= 1000 THEN held[2:] ELSE held END, k.key) END FROM walk w JOIN k ON k.n = w.n)"""


@query(f"WITH RECURSIVE {ctes('request')}, {_CACHE} SELECT seq, profile, profile = 'balanced' AND list_contains(held, key) AS cached FROM k JOIN walk USING (n)")
def cache_hits(spark, sf_dir):
    return routing.cache_outcome(fixture(spark, sf_dir, "request")).select("seq", "profile", "cached")

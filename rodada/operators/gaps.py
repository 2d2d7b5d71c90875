"""Missing connections between components of the cycling network: candidates, scores, ranking, features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodada.functions.geo import haversine_m
from rodada.functions.scores import gap_gain, gap_priority
from rodada.functions.text import numbered, without_repeats
from rodada.operators.cells import NEAR_NODES, node_cells
from rodada.operators.graph import ranked
from rodada.operators.iterative import bounded_paths, first_fit
from rodada.operators.spatial import Scale, radius_pairs
from rodada.operators.work import cut


def component_endpoints(components: DataFrame, nodes: DataFrame, least_km: float = 0.20) -> DataFrame:
    """(id, nodes' other columns, comp) of the endpoints of components of least_km or more that are in the road graph."""
    ends = components.filter(F.col("length_km") >= least_km).select(F.col("id").alias("comp"), F.explode("endpoints").alias("id"))
    return ends.join(nodes, "id")


def endpoint_pairs(endpoints: DataFrame, cos_lat: Scale, least_m: float = 35.0, most_m: float = 850.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, comp_a, comp_b, crow_m) of endpoints of different components of a group, in (component, node) order."""
    near = radius_pairs(endpoints, endpoints, most_m * 1.01, cos_lat, by=by)  # planar metres bound the candidates
    crow = haversine_m(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat"))
    pairs = near.filter((F.col("l_comp") < F.col("r_comp"))).withColumn("crow_m", crow).filter(F.col("crow_m").between(least_m, most_m))
    return pairs.select(*(F.col(f"l_{c}").alias(c) for c in by), F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col("l_comp").alias("comp_a"), F.col("r_comp").alias("comp_b"), "crow_m")


def path_hops(paths: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Hops of paths(key, path) with the edges' attributes; an edge that isn't there has nulls."""
    hops = paths.select(key, F.posexplode(F.expr("transform(slice(path, 1, size(path) - 1), (x, i) -> struct(x as u, path[i + 1] as v))")).alias("pos", "hop")).select(key, "pos", "hop.u", "hop.v")
    return hops.join(edges, ["u", "v"], "left")


def gap_candidates(edges: DataFrame, nodes: DataFrame, components: DataFrame, cos_lat: Scale, most_path_m: float = 1200.0, most_detour: float = 2.2, by: Sequence[str] = (), **limits) -> DataFrame:
    """Scored candidates, one for each endpoint pair that has a short enough road path in list order.

    by names columns of nodes and components: each group is a network of its own, with node ids that no other has.
    """
    ends = component_endpoints(components.drop(*(c for c in components.columns if c in by)), nodes.select("id", "lon", "lat", *dict.fromkeys([*by, *([cos_lat] if isinstance(cos_lat, str) else [])])))
    pairs = cut(endpoint_pairs(ends, cos_lat, by=by, **limits))
    roads = edges.select("u", "v", F.col("length_m").alias("w"))
    reached = bounded_paths(roads, pairs.select(F.col("a").alias("query"), F.col("a").alias("node")), most_path_m, pairs.select(F.col("a").alias("query"), F.col("b").alias("node")), cells=lambda: node_cells(nodes, NEAR_NODES, tuple(by)))
    found = pairs.join(reached.select(F.col("query").alias("a"), F.col("node").alias("b"), F.col("dist").alias("gap_m"), "path"), ["a", "b"]).filter(F.col("gap_m") <= F.col("crow_m") * most_detour)
    found = found.withColumn("key", F.struct("a", "b"))
    hops = path_hops(found, edges, "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "highway"))).alias("h"), F.avg(F.coalesce("penalty_factor", F.lit(1.0))).alias("avg_penalty"))
    stops = found.select("key", F.posexplode("path").alias("pos", "id")).join(nodes.select("id", "lon", "lat"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("c"))
    comp = lambda x: components.select(*by, F.col("id").alias(f"comp_{x}"), F.col("length_km").alias(f"{x}_km"))
    full = found.join(hops, "key").join(stops, "key").join(comp("a"), [*by, "comp_a"]).join(comp("b"), [*by, "comp_b"])
    gain = gap_gain(F.col("a_km"), F.col("b_km"), F.col("gap_m"))
    return full.select(
        *by, F.col("comp_a").alias("comp_a_id"), F.col("comp_b").alias("comp_b_id"), F.col("a_km").alias("comp_a_km"), F.col("b_km").alias("comp_b_km"), F.col("a").alias("node_origin"), F.col("b").alias("node_dest"),
        F.round("gap_m", 1).alias("gap_length_m"), F.round("crow_m", 1).alias("crow_distance_m"), gain["connected_network_km"].alias("connected_network_km"), gain["network_gain_km"].alias("network_gain_km"), gain["gain_ratio"].alias("gain_ratio"),
        gap_priority(F.col("a_km"), F.col("b_km"), F.col("gap_m"), F.col("avg_penalty")).alias("priority_score"),
        without_repeats(F.transform("h", lambda x: x["name"])).alias("streets"), F.array_distinct(F.filter(F.transform("h", lambda x: x["highway"]), lambda x: x != "")).alias("highway_types"),
        F.round("avg_penalty", 2).alias("avg_penalty"), F.col("path").alias("path_nodes"), F.transform("c", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"),
    )


def best_of_pairs(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best candidate of each pair of components (of a group): highest score, then smallest nodes."""
    order = F.struct(-F.col("priority_score"), "node_origin", "node_dest")
    best = candidates.groupBy(*by, "comp_a_id", "comp_b_id").agg(F.min_by(F.struct(*candidates.columns), order).alias("b"))
    return best.select("b.*")


def overlap_conflicts(rows: DataFrame, share: float = 0.60) -> DataFrame:
    """(later, earlier) of rows(id, path_nodes) that share more than that share of the smaller path's nodes.

    The smaller path only asks for its rarest nodes, as many as can't all be missing from a partner, so nodes that many
    paths pass through are seldom joined on. What meets there is compared exactly.
    """
    sets = rows.select("id", F.array_distinct("path_nodes").alias("nodes")).withColumn("n", F.size("nodes"))
    at = cut(sets.select("id", "n", F.explode("nodes").alias("node")))
    often = at.groupBy("node").agg(F.count("*").alias("times"))
    rare = F.row_number().over(Window.partitionBy("id").orderBy("times", "node"))
    asked = at.join(often, "node").withColumn("k", rare).filter(F.col("k") <= F.col("n") - F.floor(F.col("n") * share))
    small, large = asked.select(F.col("id").alias("s"), F.col("n").alias("s_n"), "node"), at.select(F.col("id").alias("l"), F.col("n").alias("l_n"), "node")
    pairs = small.join(large, "node").filter("s <> l and s_n <= l_n").select("s", "l").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("nodes").alias(f"{x}_nodes"))
    both = pairs.join(side("s"), "s").join(side("l"), "l").filter(F.size(F.array_intersect("s_nodes", "l_nodes")) > F.size("s_nodes") * share)
    return both.select(F.greatest("s", "l").alias("later"), F.least("s", "l").alias("earlier")).distinct()


def rank_gaps(candidates: DataFrame, most: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Ranked, non-overlapping candidates (of each group): best of each pair, by score, without those that overlap a better one."""
    rows = ranked(best_of_pairs(candidates, by), [*by, F.desc("priority_score"), F.asc("comp_a_id"), F.asc("comp_b_id")], "id")
    kept = rows.join(first_fit(rows.select("id"), overlap_conflicts(rows)), "id", "left_semi")
    return ranked(kept, [F.asc("id")], "rank", by).drop("id").filter(F.col("rank") <= most)


def gap_features(gaps: DataFrame, city: Column) -> DataFrame:
    """Feature properties and coordinates of ranked gaps."""
    first = F.coalesce(F.get("streets", 0), F.lit("Conexión barrial"))
    shown = F.when(F.size("streets") > 0, F.array_join(F.slice("streets", 1, 3), ", ")).otherwise("Vías urbanas")
    metres = F.col("gap_length_m").cast("int")
    about = F.concat(F.lit("Conexión posible de unos "), metres.cast("string"), F.lit(" m; uniría "), F.col("connected_network_km").cast("string"), F.lit(" km de red ciclista hoy separada."))
    return gaps.select(
        numbered("gap", city, F.col("rank")).alias("id"), F.concat(F.format_string("Oportunidad #%02d: ", "rank"), first).alias("name"), F.lit("ALGORITHMIC_CANDIDATE").alias("status"), F.lit(False).alias("is_demo"),
        "rank", "priority_score", metres.alias("gap_length_m"), F.col("comp_a_km").alias("component_a_km"), F.col("comp_b_km").alias("component_b_km"), "connected_network_km", "network_gain_km", "gain_ratio",
        "streets", shown.alias("streets_display"), "highway_types", about.alias("description"), "coordinates",
    )

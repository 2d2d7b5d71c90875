"""Batched routing: snapping, cheapest and shortest routes of many requests at once, metrics, and the route cache."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rodada.functions.scores import ratio
from rodada.functions.text import route_key, without_repeats
from rodada.operators.cells import CellSearch, id_cells
from rodada.operators.gaps import path_hops
from rodada.operators.iterative import SMALL, adjacency, broadcast_graph
from rodada.operators.spatial import Scale, nearest
from rodada.operators.work import cut


def snap(points: DataFrame, nodes: DataFrame, cos_lat: Scale, most_m: float | Column = 500.0, by: Sequence[str] = ()) -> DataFrame:
    """points (id, lon, lat) with node_id, snap_m of the nearest node (haversine; of their group), and out_of_bounds."""
    found = nearest(points, nodes, cos_lat, metric="haversine", by=by).withColumnsRenamed({"near_id": "node_id", "near_m": "snap_m"})
    limit = most_m if isinstance(most_m, Column) else F.lit(most_m)
    return found.withColumn("out_of_bounds", F.col("snap_m").isNull() | (F.col("snap_m") > limit))


def best_routes(out: dict[int, list[tuple[int, float]]], src: int, dsts: set[int]) -> dict[int, tuple[float, list[int]]]:
    """dst -> (total, path) of those that src reaches: Dijkstra until all are found, ties to the smaller predecessor."""
    dist, came, heap, done, found = {src: 0.0}, {}, [(0.0, src)], set(), {}
    while heap and len(found) < len(dsts):
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u in dsts:
            path = [u]
            while path[-1] != src:
                path.append(came[path[-1]])
            found[u] = (d, path[::-1])
        for v, w in out.get(u, ()):
            nd, had = d + w, dist.get(v, float("inf"))
            if nd < had or (nd == had and u < came.get(v, u)):
                dist[v], came[v] = nd, u
                heapq.heappush(heap, (nd, v))
    return found


def shortest_routes(pairs: DataFrame, edges: DataFrame, weights: tuple[str, ...], small: int = SMALL, cells: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, total, path) of distinct pairs (src, dst) under each weight; pairs without a route are missing.

    A graph of up to `small` edges (the largest known city has some 65,000) is broadcast, and each task searches from
    the sources that it has, once for all destinations of a source. In a larger graph a search passes from cell to cell
    (cells.CellSearch), so that no task holds more than one, and no farther than its destinations ask for; cells
    (node, cell) default to stretches of ids.
    """
    asked = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct().groupBy("src").agg(F.collect_list("dst").alias("dsts"))
    schema = "src long, dst long, weight string, total double, path array<long>"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int64()))

    def rows_of(out: dict, name: str, src: int, dsts: list[int]) -> list[tuple]:
        return [(src, dst, name, d, path) for dst, (d, path) in best_routes(out, src, set(dsts)).items()]

    graph = broadcast_graph(edges, "u", "v", weights, small)
    if graph is not None:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            outs = None
            for batch in batches:
                outs = [adjacency(graph.value, k) for k in range(len(weights))] if outs is None else outs
                for src, dsts in zip(batch.column("src").to_pylist(), batch.column("dsts").to_pylist(), strict=True):
                    rows = [x for name, out in zip(weights, outs, strict=True) for x in rows_of(out, name, src, dsts)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["src", "dst", "weight", "total", "path"])

        return asked.repartition("src").mapInArrow(search, schema)
    asked = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()
    if cells is None:
        cells = id_cells(edges.select(F.explode(F.array("u", "v")).alias("node")))
    each = edges.select("u", "v", F.explode(F.array(*(F.struct(F.lit(w).alias("graph"), F.col(w).alias("w")) for w in weights))).alias("e")).select("e.graph", "u", "v", "e.w")
    names = F.explode(F.array(*map(F.lit, weights))).alias("graph")
    lines = _widening(cut(each), cut(cells), cut(asked.select(names, "src", "dst")))
    return lines.select(F.col("query").alias("src"), F.col("node").alias("dst"), F.col("graph").alias("weight"), F.col("dist").alias("total"), F.reverse("path").alias("path"))


#: First cap of searches in mean lengths of an edge, and by how much the next one is wider.
FIRST_EDGES, WIDER = 128, 4


def _widening(each: DataFrame, cells: DataFrame, open_: DataFrame) -> DataFrame:
    """CellSearch.paths of all of open_ (graph, src, dst) over each (graph, u, v, w), by searches that widen until all is settled.

    What a search finds within its cap is final. A pair has no route if its source has no edge that leads beyond the cap,
    or its destination none, read backwards. So work grows with how far the destinations are, not with the graph.
    """
    means = each.groupBy("graph").agg(F.avg("w").alias("mean")).agg(F.max("mean")).first()  # a row a graph
    cap, parts = FIRST_EDGES * (means[0] or 1.0), []
    ahead = CellSearch(each, cells, cap)
    back = CellSearch(each.select("graph", F.col("v").alias("u"), F.col("u").alias("v"), "w"), cells, cap)
    while not open_.isEmpty():
        ahead.cap = back.cap = cap
        found = cut(ahead.run(open_.select("graph", F.col("src").alias("query"), F.col("src").alias("node"))))
        parts.append(cut(ahead.paths(found, open_.select("graph", F.col("src").alias("query"), F.col("dst").alias("node")))))
        left = cut(open_.join(parts[-1].select("graph", F.col("query").alias("src"), F.col("node").alias("dst")), ["graph", "src", "dst"], "left_anti"))
        if left.isEmpty():
            break
        going = _beyond(found, ahead).withColumnRenamed("query", "src")
        left = cut(left.join(going, ["graph", "src"], "left_semi"))
        if left.isEmpty():
            break
        came = cut(back.run(left.select("graph", F.col("dst").alias("query"), F.col("dst").alias("node"))))
        open_ = cut(left.join(_beyond(came, back).withColumnRenamed("query", "dst"), ["graph", "dst"], "left_semi"))
        cap *= WIDER
    if not parts:
        return ahead.paths(ahead.run(open_.select("graph", F.col("src").alias("query"), F.col("src").alias("node"))), open_.select("graph", F.col("src").alias("query"), F.col("dst").alias("node")))
    return reduce(DataFrame.unionByName, parts)


def _beyond(found: DataFrame, search: CellSearch) -> DataFrame:
    """(graph, query) of searches that the cap has cut: an edge leads from what they found to a node that they didn't."""
    over = found.select("graph", "query", F.col("node").alias("u"), "dist").join(search.edges.select("graph", "u", F.col("v").alias("node"), "w"), ["graph", "u"]).filter(F.col("dist") + F.col("w") > search.cap)
    return over.join(found.select("graph", "query", "node"), ["graph", "query", "node"], "left_anti").select("graph", "query").distinct()


def path_metrics(routes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Metrics of routes(key, path): distance, cycling share, cost, streets. Paths under two nodes have zeros."""
    hops = path_hops(routes.select(key, "path"), edges, key)
    length = F.coalesce("length_m", F.lit(0.0))
    sums = hops.groupBy(key).agg(
        F.sum(length).alias("m"), F.sum(F.when(F.col("is_cycling_infra"), length).otherwise(0.0)).alias("infra"), F.sum(F.coalesce("cost", length)).alias("cost"), F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("names")
    )
    all_ = routes.select(key, "path").join(sums, key, "left").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("m", "infra", "cost")})  # whatever the order of the sum
    streets = F.coalesce(without_repeats(F.transform("names", lambda x: x["name"])), F.expr("cast(array() as array<string>)"))
    return all_.select(key, "path", F.round("m", 1).alias("distance_m"), F.round(F.col("m") / 1000, 2).alias("distance_km"), F.round(F.col("infra") / 1000, 2).alias("cycling_infra_km"), ratio(F.col("infra"), F.col("m"), 1, True).alias("cycling_infra_pct"), F.round("cost", 1).alias("cost_score"), streets.alias("streets"))


def route_batch(requests: DataFrame, nodes: DataFrame, edges: DataFrame, cos_lat: Scale, most_snap_m: float | Column = 500.0, by: Sequence[str] = ()) -> DataFrame:
    """Answers of requests (id, o_lon, o_lat, d_lon, d_lat): both routes, their comparison, or an error.

    most_snap_m may be a column of requests. by names columns of requests and nodes (a city): requests then find nodes of
    their own group, and the answers carry them.
    """
    group = list(dict.fromkeys([*by, *([cos_lat] if isinstance(cos_lat, str) else [])]))
    ends = requests.select(F.col("id").alias("req"), F.explode(F.array(F.struct(F.lit("o").alias("end"), F.col("o_lon").alias("lon"), F.col("o_lat").alias("lat")), F.struct(F.lit("d").alias("end"), F.col("d_lon").alias("lon"), F.col("d_lat").alias("lat")))).alias("e"), *group)
    points = ends.select(F.struct("req", "e.end").alias("id"), "e.lon", "e.lat", *group)
    snapped = cut(snap(points, nodes, cos_lat, by=by).select("id.req", "id.end", "node_id", "snap_m"))
    side = lambda x, to: snapped.filter(F.col("end") == x).select(F.col("req").alias("id"), F.col("node_id").alias(to), F.col("snap_m").alias(f"{to}_snap_m"))
    limit = most_snap_m if isinstance(most_snap_m, Column) else F.lit(most_snap_m)
    asked = requests.withColumn("_limit", limit).join(side("o", "src"), "id").join(side("d", "dst"), "id")
    asked = asked.withColumns({f"{to}_out": F.col(f"{to}_snap_m").isNull() | (F.col(f"{to}_snap_m") > F.col("_limit")) for to in ("src", "dst")} | {f"{to}_snap_m": F.round(f"{to}_snap_m", 1) for to in ("src", "dst")})
    good = asked.filter("not src_out and not dst_out").select("src", "dst")
    routes = cut(shortest_routes(good, edges, ("cost", "length_m")))
    measured = path_metrics(routes.select(F.struct("src", "dst", "weight").alias("odw"), "path"), edges, "odw")
    one = F.struct("path", "distance_m", "distance_km", "cycling_infra_km", "cycling_infra_pct", "cost_score", "streets")
    of = lambda weight: F.max(F.when(F.col("odw.weight") == weight, one))  # noqa: E731  one row of each weight
    both = measured.groupBy(F.struct("odw.src", "odw.dst").alias("od")).agg(of("cost").alias("cycling"), of("length_m").alias("shortest"))
    c, s = F.col("cycling"), F.col("shortest")
    compared = both.select("od.src", "od.dst", "cycling", "shortest", F.struct(
        F.round(c["distance_km"] - s["distance_km"], 2).alias("distance_diff_km"), ratio(c["distance_m"] - s["distance_m"], s["distance_m"], 1, True).alias("length_diff_pct"),
        F.round(c["cycling_infra_pct"] - s["cycling_infra_pct"], 1).alias("cycling_gain_pct"), (c["path"] == s["path"]).alias("is_same_path")).alias("comparison"))
    error = F.when(F.col("src_out") | F.col("dst_out"), F.lit("out_of_bounds")).when(F.col("cycling").isNull(), F.lit("no_route"))
    return asked.join(compared, ["src", "dst"], "left").select("id", *by, "src", "dst", "src_snap_m", "dst_snap_m", "cycling", "shortest", "comparison", error.alias("error"))


def cache_outcome(requests: DataFrame, seq: str = "seq", capacity: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """requests (seq, coordinates, profile) with the cache key and `cached`: a balanced request whose key was stored.

    Each group of by (a city) has a cache of its own. Every request stores its key; only balanced ones read. In a group
    with fewer keys than the capacity nothing is evicted, and the first request of a key tells. In a larger one each hit
    depends on all requests before it: they stream through a task in order, which holds the stored keys alone.
    """
    keyed = requests.withColumn("key", route_key(*(F.col(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")))).withColumn("_group", F.to_json(F.struct(*by)) if by else F.lit(""))
    keys = keyed.groupBy("_group", "key").agg(F.min(seq).alias("_first"))
    full = keys.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") >= capacity).select("_group")
    first = keyed.join(full, "_group", "left_anti").join(keys, ["_group", "key"]).withColumn("cached", (F.col("profile") == "balanced") & (F.col(seq) > F.col("_first"))).drop("_first")
    evicting = keyed.join(full, "_group", "left_semi").repartition("_group").sortWithinPartitions("_group", seq)

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, cache = None, None
        for f in frames:
            hits = []
            for at, key, profile in zip(f["_group"], f["key"], f["profile"], strict=True):
                if at != group:
                    group, cache = at, RouteCache(capacity)
                hits.append(cache.meet(key, profile))
            yield f.assign(cached=hits)

    replayed = evicting.mapInPandas(replay, StructType([*evicting.schema, StructField("cached", BooleanType())]))
    return first.unionByName(replayed).drop("_group")


class RouteCache:
    """Stored keys in the order of insertion; at capacity a store drops the oldest one first."""

    def __init__(self, capacity: int):
        self.capacity, self.stored = capacity, {}

    def meet(self, key: str, profile: str) -> bool:
        """Whether the request is answered from the cache; if it isn't, its key is stored."""
        hit = profile == "balanced" and key in self.stored
        if not hit:
            if len(self.stored) >= self.capacity:
                del self.stored[next(iter(self.stored))]
            self.stored[key] = None
        return hit


def cache_replay(requests: Iterator[dict], capacity: int = 1000) -> Iterator[bool]:
    """The hits of requests in order."""
    cache = RouteCache(capacity)
    for r in requests:
        yield cache.meet(r["key"], r["profile"])


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")

"""Building a city: from its element documents to tables and layers. `python -m rodada.plans.build --help`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodada.functions.geo import cos_latitude
from rodada.functions.tags import ACCESS_HIGHWAYS, classify_cycleway, cycleway_display
from rodada.operators import gaps, graph
from rodada.operators.expansion import cluster_report, coverage, plan_cities, plan_expansion, points
from rodada.operators.graph import access_nodes, cycling_nodes
from rodada.operators.pois import deduplicate_pois, parse_pois
from rodada.operators.work import cut
from rodada.plans.catalog import enabled_cities, od_pairs
from rodada.plans.reports import city_document, component_totals, expansion_totals, gap_totals, layer_totals, suggested_routes, with_expansion
from rodada.plans.service import city_graph
from rodada.plans.stack import stacked, stacked_graphs, unstacked
from rodada.sources.osm import cycleway_scan, place_scan, read_elements, read_registry, road_scan, split_elements
from rodada.sources.raw import exists, publish
from rodada.sources.sinks import write_collection, write_features, write_graph


def cycleway_layer(elements, city: str):
    """Features of the cycling ways with two known nodes or more."""
    nodes, ways = split_elements(cycleway_scan(elements))
    lines = graph.way_lines(ways, nodes).join(ways.select(F.col("id").alias("way_id"), "tags"), "way_id")
    kind, show = classify_cycleway(F.col("tags")), cycleway_display(F.col("tags"))
    return lines.select(
        F.concat(F.lit(f"{city}-osm-"), "way_id").alias("id"), show["name"].alias("name"), show["has_custom_name"].alias("has_custom_name"), kind["label"].alias("type"), kind["category"].alias("category"),
        F.col("tags")["highway"].alias("highway"), *(show[c].alias(c) for c in ("surface", "surface_display", "segregated", "segregated_display")), F.col("tags")["oneway"].alias("oneway"),
        F.round("length_m", 1).alias("length_m"), F.round(F.col("length_m") / 1000, 2).alias("length_km"), F.col("way_id").alias("source_id"), F.lit(False).alias("is_demo"), F.col("tags").alias("raw_osm_tags"), F.col("coords").alias("coordinates"),
    )


#: What is published of a city.
PUBLISHED = ("city", "cycling-infrastructure", "missing-connections", "suggested-routes", "network-expansion", *(f"{x}.geojson" for x in ("cycling-infrastructure", "missing-connections", "suggested-routes", "network-expansion")))


def plan_city(spark: SparkSession, city: str, nodes: DataFrame, edges: DataFrame, places: DataFrame, out: str, cos_lat: float, max_phases: int = 6) -> DataFrame | None:
    """Write the expansion layer of a built city and put its totals into the city's document; returns the totals.

    The layer is a GeoJSON document whose metadata are the totals, the counts by type and context, and the clusters that
    were under-served before the first phase.
    """
    plan = plan_expansion(city, nodes, edges, places, cos_lat, max_phases)
    if plan is None:
        return None
    plan = cut(plan)
    here = {"city": F.lit(city), "cos_lat": F.lit(cos_lat)}
    base = coverage(points(access_nodes(edges, ACCESS_HIGHWAYS), nodes), points(cycling_nodes(edges), nodes), cos_lat)
    totals = cut(expansion_totals(plan, base))
    clusters = cluster_report(nodes.withColumns(here), edges, places.withColumns(here)).drop("city")
    report = clusters.agg(F.array_sort(F.collect_list(F.struct(*clusters.columns))).alias("clusters"))  # ten clusters at most
    rows = phase_lines(plan, nodes.select("id", "lon", "lat"))
    write_features(rows, f"{out}/{city}/network-expansion")
    write_collection(rows, f"{out}/{city}/network-expansion.geojson", "network-expansion", totals.crossJoin(report), "phase")  # one row each
    if exists(spark, f"{out}/{city}/city"):
        document = spark.read.json(f"{out}/{city}/city")
        write_city(with_expansion(document, totals, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), out, city)
    return totals


def phase_lines(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """The phases with id and coordinates of their paths."""
    stops = plan.select("phase_id", F.posexplode("path").alias("pos", "id")).join(nodes, "id").groupBy("phase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("c"))
    return plan.join(stops, "phase_id").withColumn("coordinates", F.transform("c", lambda x: F.array(x["lon"], x["lat"]))).drop("c", "seq").withColumnRenamed("phase_id", "id")


def plan_all(spark: SparkSession, cities: DataFrame, places: DataFrame, out: str, max_phases: int = 6, min_samples: int = 20) -> DataFrame | None:
    """Plan all of cities (city) that have a graph under out by one plan; places (city, id, name, category, lon, lat).

    Writes the phases of every city, with lines, to the table expansions, partitioned by city; returns (city, phases,
    length_km, new_nodes, new_pois), or None if no city has a graph.
    """
    graphs = stacked_graphs(spark, out, cities)
    if graphs is None:
        return None
    numbers, nodes, edges = graphs
    nodes, known = cut(nodes), stacked(numbers, places, "id")
    kept = deduplicate_pois(known, "cos_lat", by=("city",))
    plan = cut(plan_cities(nodes, edges, kept, max_phases, min_samples))
    lines = phase_lines(plan, nodes.select("id", "lon", "lat")).withColumnRenamed("city", "city_id")
    unstacked(lines, ("target", "origin"), ("path",)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city_id").parquet(f"{out}/expansions")
    return plan.groupBy("city").agg(F.count("*").alias("phases"), F.round(F.sum("length_km"), 2).alias("length_km"), F.sum("new_nodes").alias("new_nodes"), F.sum("new_pois").alias("new_pois"))


def write_city(document: DataFrame, out: str, city: str) -> None:
    """The city's document: one row of JSON."""
    cut(document).coalesce(1).write.mode("overwrite").json(f"{out}/{city}/city")


def build_city(spark: SparkSession, city: str, elements_path: str, out: str, cos_lat: float | None = None, max_phases: int = 6, registry: DataFrame | None = None, publish_to: str | None = None) -> dict[str, int]:
    """Write the city's graph tables, layers and document under out, and publish copies; returns row counts.

    The scale of longitudes is that of the middle of the registry's bounding box (south, west, north, east), or else of
    the city's nodes.
    """
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    elements = read_elements(spark, elements_path)
    row = None if registry is None else registry.filter(F.col("id") == city)
    layer = cut(cycleway_layer(elements, city))
    write_features(layer, f"{out}/{city}/cycling-infrastructure")
    write_collection(layer, f"{out}/{city}/cycling-infrastructure.geojson", "cycling-infrastructure", layer_totals(layer), "source_id")
    nodes, ways = split_elements(road_scan(elements))
    tags = ways.select(F.col("id").alias("way_id"), "tags")
    edges = cut(graph.largest_component(cut(graph.directed_edges(graph.way_positions(ways), tags, nodes))))
    used = cut(nodes.join(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"))
    if cos_lat is None:
        box = None if row is None else row.select(cos_latitude(F.get("bbox", 0), F.get("bbox", 2)).alias("c")).first()
        cos_lat = box["c"] if box and box["c"] is not None else used.agg(cos_latitude(F.min("lat"), F.max("lat")).alias("c")).first()["c"]
    write_graph(used, edges, out, city)
    routes = 0
    if row is not None:
        found = cut(suggested_routes(od_pairs(row), used, edges, cos_lat))
        write_features(found, f"{out}/{city}/suggested-routes")
        write_collection(found, f"{out}/{city}/suggested-routes.geojson", "suggested-routes", F.struct(F.lit(city).alias("city")), "id")
        routes = found.count()
    comps = cut(graph.components(graph.cycling_edges(edges), used))
    ranked = cut(gaps.rank_gaps(cut(gaps.gap_candidates(edges, used, comps, cos_lat)), 10))
    features = gaps.gap_features(ranked, F.lit(city))
    write_features(features, f"{out}/{city}/missing-connections")
    write_collection(features, f"{out}/{city}/missing-connections.geojson", "missing-connections", component_totals(comps).crossJoin(gap_totals(ranked)), "rank")  # one row each
    places = cut(deduplicate_pois(parse_pois(place_scan(elements)), cos_lat))
    if row is not None:
        write_city(city_document(row, layer, comps, ranked, list(PUBLISHED[1:4]), at), out, city)
    totals = plan_city(spark, city, used, edges, places, out, cos_lat, max_phases)
    if publish_to:
        publish(spark, f"{out}/{city}", f"{publish_to}/{city}", PUBLISHED)
    phases = 0 if totals is None else totals.first()["total_phases"]
    return {"cycleways": layer.count(), "nodes": used.count(), "edges": edges.count(), "routes": routes, "components": comps.count(), "gaps": ranked.count(), "places": places.count(), "phases": phases}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build cities' tables and layers from element documents (<elements>/<city>.json).")
    p.add_argument("registry")
    p.add_argument("elements")
    p.add_argument("out")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--city")
    which.add_argument("--all-enabled", action="store_true")
    p.add_argument("--refresh", action="store_true", help="build again what is there")
    p.add_argument("--plan-only", action="store_true", help="plan the expansion of a city whose graph is there")
    p.add_argument("--max-phases", type=int, default=6)
    p.add_argument("--publish")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("rodada-build").getOrCreate()
    registry = read_registry(spark, a.registry)
    names = [a.city] if a.city else [r["id"] for r in enabled_cities(registry).select("id").orderBy("id").collect()]  # a row a city
    if a.plan_only and a.all_enabled:  # one plan for all
        elements = read_elements(spark, [f"{a.elements}/{city}.json" for city in names])
        city = F.regexp_extract("file", r"([^/]+)\\.json$", 1)
        done = plan_all(spark, spark.createDataFrame([(n,) for n in names], "city string"), parse_pois(place_scan(elements).withColumn("city", city), ("city",)), a.out, a.max_phases)
        if done is None:
            raise SystemExit(f"no city has a graph under {a.out}")
        done.orderBy("city").show(len(names), False)
        return
    for city in names:
        if a.plan_only:
            built = city_graph(spark, a.out, city)
            if built is None:
                raise SystemExit(f"{city} has no graph under {a.out}")
            cos = built[0].agg(cos_latitude(F.min("lat"), F.max("lat")).alias("c")).first()["c"]
            places = cut(deduplicate_pois(parse_pois(place_scan(read_elements(spark, f"{a.elements}/{city}.json"))), cos))
            totals = plan_city(spark, city, *built, places, a.out, cos, a.max_phases)
            print(city, None if totals is None else totals.first().asDict())
        elif a.refresh or not exists(spark, f"{a.out}/{city}/city"):
            print(city, build_city(spark, city, f"{a.elements}/{city}.json", a.out, None, a.max_phases, registry, a.publish))
        else:
            print(city, "is built")


if __name__ == "__main__":
    main()

"""What a build reports about a city: suggested routes, expansion totals, and the city document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rodada.functions.scores import main_percent
from rodada.operators.routing import route_batch

#: The distance within which a route's ends must find the network.
ROUTE_SNAP_M = 650.0


def suggested_routes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, cos_lat: Column | float) -> DataFrame:
    """Features of catalog.od_pairs' routes; pairs without a route, or away from the network, are left out."""
    requests = pairs.select("id", F.get("origin", 0).alias("o_lon"), F.get("origin", 1).alias("o_lat"), F.get("destination", 0).alias("d_lon"), F.get("destination", 1).alias("d_lat"))
    answers = route_batch(requests, nodes, edges, cos_lat, ROUTE_SNAP_M).filter("error is null")
    stops = answers.select("id", F.posexplode("cycling.path").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    lines = stops.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("c")).select("id", F.transform("c", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    full = answers.join(lines, "id").join(pairs.select("id", "name", "description", "origin_name", "dest_name"), "id")
    c = lambda name: F.col(f"cycling.{name}").alias(name)
    return full.select(
        "id", "name", F.coalesce("description", F.concat(F.lit("Conexión ciclista "), "name")).alias("description"), F.coalesce("origin_name", F.lit("Origen")).alias("origin_name"), F.coalesce("dest_name", F.lit("Destino")).alias("dest_name"),
        F.lit(False).alias("is_demo"), F.lit("ALGORITHMIC_RECOMMENDED").alias("status"), F.lit("Corredor ciclista recomendado").alias("category"), c("distance_km"), c("distance_m"), c("cycling_infra_km"), c("cycling_infra_pct"), c("cost_score"),
        F.col("shortest.distance_km").alias("shortest_distance_km"), F.col("shortest.cycling_infra_pct").alias("shortest_cycling_infra_pct"), "comparison.*", F.slice("cycling.streets", 1, 8).alias("streets"), "coordinates",
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """One row with a map from the column's values to their number; an empty map without rows."""
    each = rows.groupBy(column).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias("m"))
    return each.select(F.coalesce("m", F.expr("cast(map() as map<string,bigint>)")).alias(column))


def expansion_totals(plan: DataFrame, base: DataFrame) -> DataFrame:
    """One row: phases, kilometres, gains, coverage in percent, and counts by type and context.

    base is expansion.coverage's row (points, covered, covered_pct) before the first phase.
    """
    sums = plan.agg(F.count("*").alias("total_phases"), F.round(F.coalesce(F.sum("length_km"), F.lit(0.0)), 2).alias("total_expansion_km"), F.coalesce(F.sum("new_nodes"), F.lit(0)).alias("total_new_nodes"), F.coalesce(F.sum("new_pois"), F.lit(0)).alias("total_new_pois"))
    final = F.round((F.col("covered") + F.col("total_new_nodes")) / F.greatest("points", F.lit(1)) * 100.0, 1)
    one = sums.crossJoin(base.select("points", "covered", "covered_pct")).crossJoin(counts_by(plan, "expansion_type")).crossJoin(counts_by(plan, "urban_context"))  # one row each
    return one.select("total_phases", "total_expansion_km", F.col("total_new_nodes").alias("total_new_urban_access_nodes"), "total_new_nodes", F.round(final - F.col("covered_pct"), 2).alias("total_coverage_gain_pct"), "total_new_pois", F.col("expansion_type").alias("expansion_types_summary"), F.col("urban_context").alias("urban_contexts_summary"))


def layer_totals(layer: DataFrame) -> DataFrame:
    """One row: features and kilometres of a layer of lines."""
    return layer.agg(F.count("*").alias("cycleways_count"), F.round(F.coalesce(F.sum("length_m"), F.lit(0.0)) / 1000, 2).alias("total_km"))


def component_totals(components: DataFrame) -> DataFrame:
    """One row: components, main and isolated ones, the sum of their lengths, and endpoints."""
    main = F.max(F.when(F.col("id") == 1, F.col("length_km")))
    return components.agg(F.count("*").alias("total_components"), F.coalesce(main, F.lit(0.0)).alias("main_component_km"), F.count_if(F.col("length_km") < 1.0).alias("isolated_components_count"), F.round(F.coalesce(F.sum("length_km"), F.lit(0.0)), 2).alias("components_km"), F.coalesce(F.sum(F.size("endpoints")), F.lit(0)).alias("endpoints_count"))


def gap_totals(gaps: DataFrame) -> DataFrame:
    """One row: ranked gaps (a dozen at most), the upper median of their lengths, the best score."""
    sizes = F.array_sort(F.collect_list("gap_length_m"))
    middle = F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")).cast("int")
    return gaps.agg(F.count("*").alias("selected_opportunities_count"), F.coalesce(middle, F.lit(0)).alias("median_gap_m"), F.coalesce(F.max("priority_score"), F.lit(0.0)).alias("max_score"))


def city_document(city: DataFrame, layer: DataFrame, components: DataFrame, gaps: DataFrame, layers: list[str], at: Column, expansion: DataFrame | None = None) -> DataFrame:
    """One row: the registry's city with stats, connectivity and, where there is a plan, expansion."""
    one = city.crossJoin(layer_totals(layer)).crossJoin(component_totals(components)).crossJoin(gap_totals(gaps))  # one row each
    stats = F.struct("cycleways_count", "total_km", F.array(*map(F.lit, layers)).alias("layers_available"), at.alias("last_updated"))
    connectivity = F.struct(F.col("total_km").alias("total_cycling_km"), "total_components", "main_component_km", main_percent(F.col("main_component_km"), F.col("total_km")).alias("main_component_pct"), "isolated_components_count", "selected_opportunities_count", "median_gap_m", "max_score", at.alias("last_analyzed"))
    about = F.concat(F.lit("Red ciclista y análisis de conectividad urbana para "), F.col("name"), F.lit(", "), F.coalesce("region", F.lit("")), F.lit("."))
    own = F.col("description") if "description" in city.columns else F.lit(None).cast("string")
    document = one.select(
        "id", "name", F.coalesce("province", "name").alias("province"), F.coalesce("region", F.lit("")).alias("region"), F.coalesce("country", F.lit("Chile")).alias("country"), "center", F.coalesce("initial_zoom", F.lit(13.5)).alias("initial_zoom"),
        "bounds", "bbox", F.coalesce(own, about).alias("description"), F.coalesce("presets", F.expr("cast(array() as array<struct<id:string,name:string,coord:array<double>>>)")).alias("presets"), stats.alias("stats"), connectivity.alias("connectivity"),
    )
    return document if expansion is None else with_expansion(document, expansion, at)


def with_expansion(document: DataFrame, expansion: DataFrame, at: Column) -> DataFrame:
    """The document with its expansion block put in or replaced; older totals without access nodes lend total_new_nodes."""
    names = expansion.columns
    access = F.col("total_new_urban_access_nodes") if "total_new_urban_access_nodes" in names else F.lit(None).cast("long")
    block = F.struct(*(c for c in names if c != "total_new_urban_access_nodes"), F.coalesce(access, F.col("total_new_nodes"), F.lit(0)).alias("total_new_urban_access_nodes"), at.alias("last_analyzed"))
    return document.drop("expansion").crossJoin(expansion.select(block.alias("expansion")))  # one row each

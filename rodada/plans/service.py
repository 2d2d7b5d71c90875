"""Answers to requests, as DataFrames: health, cities, layers and routes; errors are columns, not exceptions."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rodada.functions.text import route_key
from rodada.operators.routing import cache_outcome, route_batch
from rodada.operators.work import cut
from rodada.plans import catalog
from rodada.plans.stack import stacked_graphs, unstacked
from rodada.sources.versions import current, merge

VERSION = "0.1.0"
#: The fields of a city in a list, and of a layer.
SUMMARY = ("id", "name", "province", "region", "country", "enabled", "center", "bounds", "bbox", "initial_zoom", "description", "presets", "stats", "connectivity")
ORIGINS = "http://localhost:5173,http://127.0.0.1:5173,http://localhost:3000"


def settings(env: Mapping[str, str] | None = None) -> dict:
    """Host, port, environment, allowed origins and data folder from environment variables."""
    env = os.environ if env is None else env
    origins = [o.strip() for o in env.get("CORS_ORIGINS", ORIGINS).split(",") if o.strip()]
    return {"host": env.get("HOST", "0.0.0.0"), "port": int(env.get("PORT", "8000")), "environment": env.get("ENVIRONMENT", "development"), "cors_origins": origins, "data_dir": env.get("DATA_DIR") or "data/cities"}


def health(spark: SparkSession, env: Mapping[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame([("ok", VERSION, settings(env)["environment"])], "status string, version string, environment string")


def declared(rows: DataFrame, names: tuple[str, ...] = SUMMARY) -> DataFrame:
    """The declared fields that rows have, in their order; others are dropped."""
    return rows.select(*(n for n in names if n in rows.columns))


def city_detail(spark: SparkSession, details: DataFrame, files: DataFrame, city_id: str) -> DataFrame:
    """One row: the city's document with available_layers, or error 'city_not_found'."""
    layers = catalog.available_layers(spark, files, city_id).agg(F.array_sort(F.collect_list(F.struct("id", "name", "type", "feature_count"))).alias("available_layers"))
    asked = spark.createDataFrame([(city_id,)], "id string")
    found = asked.join(details.withColumn("_there", F.lit(True)), "id", "left").crossJoin(layers)  # one row each
    return found.withColumn("error", F.when(F.col("_there").isNull(), F.lit("city_not_found"))).drop("_there")


def layer_answer(spark: SparkSession, files: DataFrame, city_id: str, layer_id: str) -> DataFrame:
    """One row: features of one layer, or error 'layer_not_found'."""
    found = files.filter((F.col("city") == city_id) & (F.col("layer") == layer_id)).select(F.lit("FeatureCollection").alias("type"), "features")
    none = spark.createDataFrame([(city_id, layer_id)], "city string, layer string").join(found, how="left")
    return none.withColumn("error", F.when(F.col("type").isNull(), F.lit("layer_not_found")))


def city_graph(spark: SparkSession, tables: str, city_id: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of one city from tables partitioned by city: other cities' files aren't read. None if it has none."""
    try:
        nodes, edges = (spark.read.parquet(f"{tables}/{x}").filter(F.col("city_id") == city_id).drop("city_id") for x in ("nodes", "edges"))
    except AnalysisException:
        return None
    return None if nodes.isEmpty() else (nodes, edges)


ANSWER = ("src", "dst", "src_snap_m", "dst_snap_m", "cycling", "shortest", "comparison")


def answer_routes(spark: SparkSession, requests: DataFrame, details: DataFrame, tables: str, cache: str | None = None) -> DataFrame:
    """Answers of requests (id, city_id, origin, destination, max_snap_dist_m = 500, profile = 'balanced', seq).

    error: invalid_coordinates (not two numbers), city_not_found, graph_not_found, out_of_bounds, no_route. All cities
    are answered by one plan. With a cache (a folder of save_route_cache), balanced requests whose key it holds get the
    stored answer and aren't searched. cached tells whether the answer came from there, or would have from the city's
    cache in memory, whose capacity evicts the oldest key.
    """
    two = lambda c: (F.size(c) == 2) & F.get(c, 0).isNotNull() & F.get(c, 1).isNotNull()
    most = F.coalesce("max_snap_dist_m", F.lit(500.0)) if "max_snap_dist_m" in requests.columns else F.lit(500.0)
    profile = F.coalesce("profile", F.lit("balanced")) if "profile" in requests.columns else F.lit("balanced")
    ends = [F.get(c, k).alias(f"{c[0]}_{x}") for c in ("origin", "destination") for k, x in enumerate(("lon", "lat"))]
    asked = cut(requests.select("id", F.col("city_id").alias("city"), "seq", F.coalesce(two("origin") & two("destination"), F.lit(False)).alias("valid"), profile.alias("profile"), most.alias("most_m"), *ends))
    known = asked.join(details.select(F.col("id").alias("city")).distinct().withColumn("known", F.lit(True)), "city", "left")
    wrong = F.when(~F.col("valid"), "invalid_coordinates").when(F.col("known").isNull(), "city_not_found")
    refused = known.filter(wrong.isNotNull()).select("id", F.col("city").alias("city_id"), wrong.alias("error"))
    good = known.filter("valid and known").drop("valid", "known").withColumn("key", route_key(*(F.col(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat"))))
    stored = None if cache is None else load_route_cache(spark, cache)
    served = None
    if stored is not None:
        # an answer whose ends are farther from the network than this request allows is no answer to it
        hits = good.filter("profile = 'balanced'").join(stored.select(F.col("city_id").alias("city"), "key", "answer"), ["city", "key"]).filter(F.greatest("answer.src_snap_m", "answer.dst_snap_m") <= F.col("most_m"))
        served = cut(hits.select("id", F.col("city").alias("city_id"), *(F.col(f"answer.{c}").alias(c) for c in ANSWER), F.lit(None).cast("string").alias("error"), "key", F.lit(True).alias("cached")))
        good = good.join(served.select("id"), "id", "left_anti")
    graphs = stacked_graphs(spark, tables, good.select("city"))
    if graphs is None:
        lost, found = good, None
    else:
        numbers, nodes, edges = graphs
        lost = good.join(numbers, "city", "left_anti")
        here = good.join(numbers.select("city", "cos_lat"), "city")
        found = unstacked(route_batch(here, nodes, cut(edges), "cos_lat", F.col("most_m"), by=("city",)), ("src", "dst"), ("cycling.path", "shortest.path"))
        found = cut(found.select("id", F.col("city").alias("city_id"), *ANSWER, "error"))
        hit = cache_outcome(here.join(found.filter("error is null").select("id"), "id", "left_semi").select("id", "city", "seq", "profile", "o_lon", "o_lat", "d_lon", "d_lat"), by=("city",)).select("id", "key", "cached")
        found = found.join(hit, "id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    out = refused.unionByName(lost.select("id", F.col("city").alias("city_id"), F.lit("graph_not_found").alias("error")))
    for answers in (served, found):
        out = out if answers is None else answers.unionByName(out, allowMissingColumns=True)
    return out


def save_route_cache(answers: DataFrame, path: str) -> None:
    """Keep answers under their city and key: of the same key what was computed last stays, all other keys stay too."""
    good = answers.filter("error is null").select("city_id", "key", "id", F.struct(*ANSWER).alias("answer"))
    merge(good, path, ("city_id", "key"), latest="id")


def load_route_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept answers (city_id, key, answer); None where none was ever saved."""
    return current(spark, path)

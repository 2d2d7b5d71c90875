"""Spatial joins by cells: radius pairs, semi and anti joins, counts, nearest neighbours.

A distance predicate alone gives Spark a nested-loop join. For radii, points get cells whose side is the radius, in
metres on both axes, one side is repeated into its 3 x 3 neighbour cells, and an equi-join on the cell is followed by
the exact distance. Work and shuffle grow with the points and their true neighbours; a crowded cell is a skewed join
key, which adaptive execution splits. For nearest neighbours, cells are divided where points are many, and a search
descends through them: each level drops the cells that are farther than the farthest corner of another one.

Points are DataFrames with id, lon, lat. Rows with a null coordinate match nothing. `by` names columns of both sides
that must be equal (a city, say), so that one job serves many groups; cos_lat may then be the name of a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodada.functions.geo import DEGREE_M, EARTH_M, around, haversine_m, metre_cells, planar_m
from rodada.operators.work import cut

Scale = Column | float | str


def scale(cos_lat: Scale, side: str = "") -> Column | float:
    """cos_lat as an expression over one side's columns."""
    return F.col(side + cos_lat) if isinstance(cos_lat, str) else cos_lat


def _celled(points: DataFrame, size_m: float, cos_lat: Scale, spread: int = 0) -> DataFrame:
    cx, cy = metre_cells(F.col("lon"), F.col("lat"), size_m, scale(cos_lat))
    p = points.filter("lon is not null and lat is not null").withColumns({"_cx": cx, "_cy": cy})
    if spread:
        p = p.withColumn("_cx", F.explode(around(F.col("_cx"), spread))).withColumn("_cy", F.explode(around(F.col("_cy"), spread)))
    return p


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, cos_lat: Scale, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(l_*, r_*, dist_m) of the pairs within radius_m (below it, if strict). Repeats `right` into neighbour cells."""
    keys = ["_cx", "_cy", *(f"_{c}" for c in by)]
    same = [F.col(c).alias(f"_{c}") for c in by]
    l = _celled(left, radius_m, cos_lat).select("_cx", "_cy", *same, *(F.col(c).alias(f"l_{c}") for c in left.columns))
    r = _celled(right, radius_m, cos_lat, 1).select("_cx", "_cy", *same, *(F.col(c).alias(f"r_{c}") for c in right.columns))
    d = planar_m(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat"), scale(cos_lat, "l_"))
    pairs = l.join(r, keys).drop(*keys).withColumn("dist_m", d)
    return pairs.filter(F.col("dist_m") < radius_m if strict else F.col("dist_m") <= radius_m)


def radius_semi(left: DataFrame, right: DataFrame, radius_m: float, cos_lat: Scale, anti: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rows of left with (anti: without) a right point within radius_m."""
    extra = [cos_lat] if isinstance(cos_lat, str) else []
    l = _celled(left, radius_m, cos_lat).alias("l")
    r = _celled(right.select("lon", "lat", *dict.fromkeys([*by, *extra])), radius_m, cos_lat, 1).alias("r")
    same = reduce(lambda x, c: x & (F.col(f"l.{c}") == F.col(f"r.{c}")), by, F.lit(True))
    near = same & (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy")) & (planar_m(F.col("l.lon"), F.col("l.lat"), F.col("r.lon"), F.col("r.lat"), scale(cos_lat, "l.")) <= radius_m)
    return l.join(r, near, "left_anti" if anti else "left_semi").drop("_cx", "_cy")


def radius_count(left: DataFrame, right: DataFrame, radius_m: float, cos_lat: Scale, name: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """left with the number of right points within radius_m."""
    extra = [*by, *([cos_lat] if isinstance(cos_lat, str) else [])]
    found = radius_pairs(left.select("id", "lon", "lat", *dict.fromkeys(extra)), right.select("lon", "lat", *dict.fromkeys(extra)), radius_m, cos_lat, by=by).groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias(name))
    return left.join(found, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


#: Levels of nearest's cells, each dividing an axis by four; and what rounding may add to a bound, in metres and as a share.
_LEVELS, _SLACK = 12, 1e-6
#: Cells of a level that are broadcast, at most; more are joined by shuffling.
_BROADCAST_CELLS = 100_000


def _axes(cos_lat: Scale, metric: str) -> dict[str, Column]:
    """Coordinates in metres whose straight-line distance grows with the metric."""
    lon, lat = F.col("lon"), F.col("lat")
    if metric == "planar":
        return {"_a0": lon * scale(cos_lat) * DEGREE_M, "_a1": lat * DEGREE_M}
    x, y = F.radians(lon), F.radians(lat)
    return {"_a0": F.cos(y) * F.cos(x) * EARTH_M, "_a1": F.cos(y) * F.sin(x) * EARTH_M, "_a2": F.sin(y) * EARTH_M}


def _divided(points: DataFrame, axes: list[str], by: Sequence[str], most: float) -> tuple[DataFrame, DataFrame] | None:
    """(cells, points in their undivided cells): a cell of more than `most` points is divided, down to the last level."""
    ends = points.agg(*(f(a).alias(f"{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max)))).first()
    if ends[f"low{axes[0]}"] is None:
        return None
    side = max(max(ends[f"high{a}"] - ends[f"low{a}"] for a in axes), 1e-6)
    bits = 2 * _LEVELS
    whole = {f"_c{k}": F.least(F.floor((F.col(a) - ends[f"low{a}"]) * ((1 << bits) / side)), F.lit((1 << bits) - 1)) for k, a in enumerate(axes)}
    names, place = list(whole), ["_level", *whole]
    each = points.withColumns(whole).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))))
    each = each.withColumns({c: F.expr(f"shiftright({c}, {bits} - 2 * _level)") for c in names})
    box = [f(a).alias(f"_{n}{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]
    all_ = cut(each.groupBy(*by, *place).agg(F.count("*").alias("_n"), *box))
    crowded = all_.filter((F.col("_n") > most) & (F.col("_level") < _LEVELS)).select(*by, *(F.col(c).alias(f"_p{c}") for c in place))
    up = {"_p_level": F.col("_level") - 1} | {f"_p{c}": F.shiftright(c, 2) for c in names}
    parent = [*by, *up]
    cells = cut(all_.withColumns(up).join(crowded, parent, "left_semi").unionByName(all_.filter("_level = 0").withColumns(up)).withColumn("_leaf", (F.col("_n") <= most) | (F.col("_level") == _LEVELS)))
    leaves = each.join(cells.filter("_leaf").select(*by, *place), [*by, *place])
    return cells, leaves


def nearest(left: DataFrame, right: DataFrame, cos_lat: Scale, most: float = 16, metric: str = "planar", by: Sequence[str] = ()) -> DataFrame:
    """left with near_id and near_m: the closest right point, the smaller id on ties; null if there is none.

    Places that many rows share are searched once. Right points lie in cells that are divided until they hold `most` of
    them. From the cell that holds all, a search goes down a level at a time and keeps what may hold the closest point:
    the cells whose nearest side isn't beyond the nearest of all the farthest corners.
    """
    axes, on = _axes(cos_lat, metric), [*by, "lon", "lat"]
    place, extra = "lon is not null and lat is not null", [cos_lat] if isinstance(cos_lat, str) else []
    there = right.filter(place).groupBy(*dict.fromkeys([*on, *extra])).agg(F.min("id").alias("near_id")).withColumns(axes)
    there = cut(there.select(*by, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "near_id", *axes))
    divided = _divided(there, list(axes), by, most)
    none = left.select(*left.columns, F.lit(None).cast(right.schema["id"].dataType).alias("near_id"), F.lit(None).cast("double").alias("near_m"))
    if divided is None:
        return none
    cells, leaves = divided
    at = ["_level", *(f"_c{k}" for k in range(len(axes)))]
    bounds = {"_near": F.sqrt(sum(F.pow(F.greatest(F.col(f"_low{a}") - F.col(a), F.col(a) - F.col(f"_high{a}"), F.lit(0.0)), 2) for a in axes)), "_far": F.sqrt(sum(F.pow(F.greatest(F.col(f"_high{a}") - F.col(a), F.col(a) - F.col(f"_low{a}")), 2) for a in axes))}
    box = [f"_{n}{a}" for a in axes for n in ("low", "high")]
    found = left.filter(place).select(*dict.fromkeys([*on, *extra])).distinct().withColumns(axes).withColumns({c: F.lit(0).cast("int" if c == "_level" else "long") for c in at})
    # the root's place is 0 on all axes, so it is joined like any other cell
    found = found.join(F.broadcast(cells.filter("_level = 0").select(*by, *at, *box)), [*by, *at]).withColumns(bounds).drop(*box)
    sizes = {r["_level"]: r["n"] for r in cells.groupBy("_level").agg(F.count("*").alias("n")).collect()}  # a row a level
    for level in range(1, max(sizes) + 1):
        below = cells.filter(F.col("_level") == level).select(*by, *(F.col(f"_p{c}").alias(c) for c in at), *(F.col(c).alias(f"_k{c}") for c in at), *box)
        below = F.broadcast(below) if sizes[level] <= _BROADCAST_CELLS else below
        inner = found.join(below, [*by, *at], "left")
        inside = F.col("_k_level").isNotNull()
        inner = inner.withColumns({b: F.when(inside, x).otherwise(F.col(b)) for b, x in bounds.items()} | {c: F.coalesce(f"_k{c}", c) for c in at}).drop(*box, *(f"_k{c}" for c in at))
        least = F.min("_far").over(Window.partitionBy(*on))
        found = inner.withColumn("_least", least).filter(F.col("_near") <= F.col("_least") * (1 + _SLACK) + _SLACK).drop("_least")
    if metric == "planar":
        d = planar_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"), scale(cos_lat))
    else:
        d = haversine_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    ends = leaves.select(*by, *at, "_lon", "_lat", "near_id")
    best = found.join(ends, [*by, *at]).groupBy(*on).agg(F.min(F.struct(d.alias("near_m"), "near_id")).alias("_b"))
    return left.join(best.select(*on, "_b.near_id", "_b.near_m"), on, "left").select(*left.columns, "near_id", "near_m")

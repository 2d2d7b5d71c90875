"""Distances and grid cells as Column expressions (no UDF): spherical and planar metres, cells, neighbour cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius and metres per degree of latitude.
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(half), F.sqrt(1 - half))


def cos_latitude(south: Column, north: Column) -> Column:
    """Planar scale of longitudes at the middle latitude."""
    return F.cos(F.radians((south + north) / 2))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos_lat: Column | float) -> Column:
    """Planar metres, for distances inside a city."""
    return F.hypot((lon2 - lon1) * cos_lat, lat2 - lat1) * DEGREE_M


def floor_cell(x: Column, size: float) -> Column:
    """Grid cell by rounding down (the snapping grid)."""
    return F.floor(x / size).cast("int")


def truncated_cell(x: Column, size: float) -> Column:
    """Grid cell by truncation towards zero (the radius and clustering grids)."""
    return (x / size).cast("int")


def metre_cells(lon: Column, lat: Column, size_m: float, cos_lat: Column | float) -> tuple[Column, Column]:
    """Cells of at least size_m metres on both axes, so what is within size_m is in the 3 x 3 cells around."""
    return F.floor(lon * cos_lat * DEGREE_M / size_m).cast("long"), F.floor(lat * DEGREE_M / size_m).cast("long")


def around(cell: Column, ring: int = 1) -> Column:
    """The cells from `ring` before to `ring` after, as an array to explode."""
    return F.sequence(cell - ring, cell + ring)


def line_length_m(coords: Column) -> Column:
    """Length of an array of [lon, lat]: haversine over consecutive points; 0 for fewer than two."""
    pairs = F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: haversine_m(a[0], a[1], b[0], b[1]))
    return F.when(F.size(coords) < 2, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))

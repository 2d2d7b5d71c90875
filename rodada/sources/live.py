"""Live scans: a data source whose partitions are tiles of a bounding box, each asked of a mirror by the task that has it.

    register(spark)
    spark.read.format("rodada_scan").option("kind", "roads").option("bbox", "-35.1,-71.3,-34.9,-71.1").option("mirrors", "https://a/,https://b/").load()

Queries are in the public query language of map mirrors. A task tries its mirrors in turn, from one that depends on the
tile, so that they share the work; a failed mirror is asked `attempts` times with growing pauses, then the next one is.
A tile that no mirror answers fails its task, which Spark runs again. No answer passes through the driver.

Conditions on type, lat and lon that stand beside the scan narrow what is asked for: tiles outside the box aren't asked, and neither are ways if only nodes are
wanted. Rows are filtered again by Spark. A way over a tile's border is in the answers of both tiles: `scan` drops copies.
"""

from __future__ import annotations

import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from rodada.sources.osm import NODE_PLACES, ROADS, WAY_PLACES
from rodada.sources.raw import first_answer
from rodada.sources.versions import current, replace

SCHEMA = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, nodes array<bigint>, tags map<string,string>"
#: kind -> (conditions on ways, conditions on nodes, whether ways come with their nodes or with a centre)
KINDS = {
    "cycleways": (['"highway"="cycleway"', *(f'"cycleway{side}"' for side in ("", ":left", ":right", ":both")), '"bicycle"="designated"'], [], "nodes"),
    "roads": ([f'"highway"~"{ROADS}"'], [], "nodes"),
    "places": ([f'"{k}"~"{v}"' for k, v in WAY_PLACES.items()], [f'"{k}"~"{v}"' for k, v in NODE_PLACES.items()], "center"),
}
Box = tuple[float, float, float, float]


def query_text(kind: str, box: Box, wait_s: int = 90, only: str | None = None) -> str:
    """What a mirror is asked for: elements of a kind in a box (south, west, north, east), of one type only if given."""
    ways, nodes, shape = KINDS[kind]
    where = ",".join(f"{x:.7f}" for x in box)
    parts = [f"node[{c}]({where});" for c in nodes if only != "way"] + [f"way[{c}]({where});" for c in ways if only != "node" or shape == "nodes"]
    out = {"nodes": "out body;>;out skel qt;", "center": "out center;"}[shape]
    return f"[out:json][timeout:{wait_s}];({''.join(parts)});{out}" if parts else ""


def tiles(box: Box, side: float) -> list[Box]:
    """The box in equal tiles, no wider than side degrees."""
    south, west, north, east = box
    rows, columns = (max(1, math.ceil((b - a) / side - 1e-9)) for a, b in ((south, north), (west, east)))
    at = lambda a, b, k, n: b if k == n else a + (b - a) * k / n
    return [(at(south, north, i, rows), at(west, east, j, columns), at(south, north, i + 1, rows), at(west, east, j + 1, columns)) for i in range(rows) for j in range(columns)]


class Tile(InputPartition):
    def __init__(self, number: int, box: Box):
        self.number, self.box = number, box


def post(mirror: str, query: str, wait_s: float) -> str:
    """The mirror's answer to a query."""
    request = urllib.request.Request(mirror, urllib.parse.urlencode({"data": query}).encode(), {"User-Agent": "rodada"})
    with urllib.request.urlopen(request, timeout=wait_s) as answer:
        return answer.read().decode()


class ScanReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.mirrors = options["kind"], [m.strip() for m in options["mirrors"].split(",") if m.strip()]
        self.box = tuple(float(x) for x in options["bbox"].split(","))
        if self.kind not in KINDS or len(self.box) != 4 or not self.mirrors:
            raise ValueError(f"a scan takes a kind of {sorted(KINDS)}, a bbox south,west,north,east, and mirrors")
        self.side, self.attempts = float(options.get("tile_degrees", "0.05")), int(options.get("attempts", "2"))
        self.pause_s, self.wait_s = float(options.get("pause_s", "2")), int(options.get("wait_s", "90"))
        self.wanted, self.only = self.box, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the box and the type; all filters stay with Spark too, since answers hold nodes outside the box."""
        south, west, north, east = self.wanted
        points = KINDS[self.kind][2] == "center"  # elsewhere ways have no place of their own, and their nodes lie anywhere
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "type" and isinstance(f, EqualTo):
                self.only = f.value
            elif points and name == "lat" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                south = max(south, f.value)
            elif points and name == "lat" and isinstance(f, (LessThan, LessThanOrEqual)):
                north = min(north, f.value)
            elif points and name == "lon" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                west = max(west, f.value)
            elif points and name == "lon" and isinstance(f, (LessThan, LessThanOrEqual)):
                east = min(east, f.value)
            yield f
        if self.only == "node":  # a place's lat and lon are a node's: ways have a centre instead
            self.wanted = (south, west, north, east)

    def partitions(self) -> list[Tile]:
        a, b = self.wanted, self.box
        if self.only not in (None, "node", "way") or a[0] > a[2] or a[1] > a[3]:
            return []
        return [Tile(k, t) for k, t in enumerate(tiles(b, self.side)) if t[0] <= a[2] and t[2] >= a[0] and t[1] <= a[3] and t[3] >= a[1]]

    def read(self, partition: Tile) -> Iterator[tuple]:
        query = query_text(self.kind, partition.box, self.wait_s, self.only)
        if not query:
            return
        turn = partition.number % len(self.mirrors)

        def ask(mirror: str) -> str:
            text = post(mirror, query, self.wait_s)
            answer = json.loads(text)
            if "elements" not in answer or "remark" in answer:  # mirrors report an overrun in an answer that looks whole
                raise ValueError(str(answer.get("remark", "no elements"))[:200])
            return text

        text = first_answer(self.mirrors[turn:] + self.mirrors[:turn], ask, self.attempts, self.pause_s, time.sleep)
        for e in json.loads(text)["elements"]:
            c = e.get("center")
            yield e["type"], e["id"], e.get("lat"), e.get("lon"), None if c is None else (c["lat"], c["lon"]), e.get("nodes"), e.get("tags")


class ScanSource(DataSource):
    """The format rodada_scan: options kind, bbox, mirrors, and tile_degrees, attempts, pause_s, wait_s."""

    @classmethod
    def name(cls) -> str:
        return "rodada_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push conditions down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)


def scan(spark: SparkSession, kind: str, box: Box, mirrors: list[str], **options) -> DataFrame:
    """Elements of a kind in a box, each once, as read_elements gives them of a document (with file and pos)."""
    register(spark)
    reader = spark.read.format("rodada_scan").options(kind=kind, bbox=",".join(map(repr, box)), mirrors=",".join(mirrors), **{k: str(v) for k, v in options.items()})
    # of a node that has tags in one tile's answer and none in another's, the one with tags stays
    whole = reader.load().groupBy("type", "id").agg(F.max_by(F.struct("lat", "lon", "center", "nodes", "tags"), F.coalesce(F.size("tags"), F.lit(-1))).alias("e"))
    return whole.select(F.lit(f"rodada_scan:{kind}").alias("file"), F.col("id").alias("pos"), "type", "id", "e.*")


def scan_through(spark: SparkSession, path: str, scanned: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """What an earlier scan left at path; scanned and put there first if there is nothing or refresh asks for it."""
    if refresh or current(spark, path) is None:
        replace(scanned(), path)
    return current(spark, path)

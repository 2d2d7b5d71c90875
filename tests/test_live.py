"""Live scans against mirrors on this machine, one of which is down and one of which fails on some tiles."""

import json
import re
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from rodada.sources import live, osm

NODES = {k: (-35.0 + (k // 10) * 0.01, -71.3 + (k % 10) * 0.01) for k in range(100)}
WAYS = {1000 + i: [i * 10 + j for j in range(10)] for i in range(10)}
PLACES = {5: {"amenity": "school"}, 55: {"amenity": "cafe"}, 99: {"shop": "mall", "name": "M"}}


def _answer(query):
    """What the query language means for the elements above: lines of conditions in a box, then nodes of ways or centres."""
    elements = []
    for kind, condition, *box in re.findall(r"(node|way)\[([^\]]+)\]\(([-\d.]+),([-\d.]+),([-\d.]+),([-\d.]+)\);", query):
        s, w, n, e = map(float, box)
        inside = lambda k: s <= NODES[k][0] <= n and w <= NODES[k][1] <= e  # noqa: B023, E731
        if kind == "node":
            key, pattern = re.match(r'"(\w+)"~"(.*)"', condition).groups()
            elements += [{"type": "node", "id": k, "lat": NODES[k][0], "lon": NODES[k][1], "tags": t} for k, t in PLACES.items() if inside(k) and re.search(pattern, t.get(key, ""))]
        elif condition.startswith('"highway"~'):
            for way, nodes in WAYS.items():
                if any(map(inside, nodes)):
                    elements.append({"type": "way", "id": way, "nodes": nodes, "tags": {"highway": "residential", "name": f"W{way}"}})
                    elements += [{"type": "node", "id": k, "lat": NODES[k][0], "lon": NODES[k][1]} for k in nodes]
    return {"elements": elements}


@pytest.fixture
def mirrors():
    asked, servers = Counter(), []

    def mirror(name, fails):
        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
                asked[name] += 1
                asked[name, query] += 1
                why = fails(query, asked[name, query])
                body = json.dumps(why if isinstance(why, dict) else _answer(query)).encode()
                self.send_response(500 if why is True else 200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        servers.append(server)
        return f"http://127.0.0.1:{server.server_port}/"

    yield mirror, asked
    for s in servers:
        s.shutdown()


BOX = (-35.0, -71.3, -34.91, -71.21)


def test_tiles_are_asked_by_tasks_and_failed_mirrors_are_passed_over(spark, mirrors):
    mirror, asked = mirrors
    down = mirror("down", lambda q, n: True)
    shaky = mirror("shaky", lambda q, n: {"remark": "runtime error", "elements": []} if n == 1 else None)
    got = live.scan(spark, "roads", BOX, [down, shaky], tile_degrees=0.03, pause_s=0.01)
    rows = got.collect()
    assert Counter(r["type"] for r in rows) == {"way": 10, "node": 100} and {r["id"]: r["nodes"] for r in rows if r["type"] == "way"} == WAYS
    assert asked["shaky"] == 18 and asked["down"] > 0 and len([k for k in asked if k[0] == "shaky" and isinstance(k, tuple)]) == 9
    nodes, ways = osm.split_elements(osm.road_scan(got))
    assert nodes.count() == 100 and ways.count() == 10
    with pytest.raises(Exception, match="no mirror"):
        live.scan(spark, "roads", BOX, [down], tile_degrees=1, pause_s=0, attempts=1).collect()


def test_filters_reach_the_mirrors(spark, mirrors):
    mirror, asked = mirrors
    ok = mirror("ok", lambda q, n: None)
    live.register(spark)
    df = spark.read.format("rodada_scan").options(kind="places", bbox=",".join(map(str, BOX)), mirrors=ok, tile_degrees="0.03").load()
    got = df.filter((F.col("type") == "node") & (F.col("lat") > -34.92) & (F.col("lon") >= -71.22)).collect()
    assert [(r["id"], r["tags"]["name"]) for r in got] == [(99, "M")]
    assert asked["ok"] == 1 and not any("way[" in k[1] for k in asked if isinstance(k, tuple))
    assert sorted(r["id"] for r in live.scan(spark, "places", BOX, [ok]).collect()) == [5, 99]


def test_scans_are_kept_and_refreshed(spark, mirrors, tmp_path):
    mirror, asked = mirrors
    ok = mirror("ok", lambda q, n: None)
    read = lambda **o: live.scan_through(spark, str(tmp_path / "x"), lambda: live.scan(spark, "places", BOX, [ok], tile_degrees=1), **o)
    assert read().count() == 2 and read().count() == 2 and asked["ok"] == 1
    assert read(refresh=True).count() == 2 and asked["ok"] == 2


def test_query_text_and_tiles():
    assert live.query_text("cycleways", (1, 2, 3, 4)).startswith("[out:json][timeout:90];(way[\"highway\"=\"cycleway\"](1.0000000,2.0000000,3.0000000,4.0000000);")
    assert live.query_text("roads", (1, 2, 3, 4)).endswith(");out body;>;out skel qt;") and "node[" not in live.query_text("places", (1, 2, 3, 4), only="way")
    t = live.tiles((0, 0, 1, 0.5), 0.25)
    assert len(t) == 8 and t[0][:2] == (0, 0) and t[-1][2:] == (1, 0.5) and live.tiles((0, 0, 0, 0), 1) == [(0, 0, 0, 0)]
    with pytest.raises(ValueError, match="kind"):
        live.ScanReader({"kind": "x", "bbox": "0,0,1,1", "mirrors": "a"})

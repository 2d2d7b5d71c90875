"""The driver's contract: names, SQL against DuckDB for a few queries, and independence from the optional subpackage."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["edge_totals", "edge_penalty", "tag_classify", "oneway_rules", "way_length", "street_runs", "ordered_distinct", "cache_hits", "topology_type", "urban_context", "dbscan", "city_components", "route_compare", "upper_median", "catalog_left_join"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]}) x").fetchall()
    show = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(map(tuple, df.select(*cols).collect())) == show(want)


def test_street_runs_have_no_row_for_a_group_without_names(spark, tmp_path):
    con, at = duckdb.connect(), f"{tmp_path}/orders.parquet"
    con.execute(f"COPY (SELECT CAST(19 * 100 * i + g AS BIGINT) AS o_orderkey, '5-LOW' AS o_orderpriority FROM range(40) a(i), (VALUES (0), (7)) b(g)) TO '{at}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}'")
    want = con.execute(entry.oracle_sql()["street_runs"]).fetchall()
    assert [tuple(r) for r in entry.queries()["street_runs"](spark, str(tmp_path)).collect()] == want and len(want) == 1


def test_plan_has_six_phases_and_all_edges(spark, monkeypatch):
    import inspect

    from rodada.operators import expansion
    from rodada.plans.queries import road_edges

    asked, real = [], inspect.signature(expansion.plan_expansion)
    monkeypatch.setattr(expansion, "plan_expansion", lambda *a, **b: asked.append(real.bind(*a, **b)))
    entry.queries()["expansion_plan"](spark, DATA)
    asked[0].apply_defaults()
    edges, all_ = asked[0].arguments["edges"], road_edges(spark, DATA)
    assert asked[0].arguments["max_phases"] == 6 and edges.select("u", "v").exceptAll(all_.select("u", "v")).isEmpty() and edges.count() == all_.count()
    assert edges.filter("is_cycling_infra").count() > 0


def test_cache_hits_evict_over_the_capacity(spark):
    from rodada.functions.text import route_key
    from rodada.operators.routing import cache_replay
    from rodada.plans.fixtures import fixture

    data = "/root/testdata/sf0.01"
    rows = fixture(spark, data, "request").withColumn("key", route_key(*("o_lon o_lat d_lon d_lat".split()))).orderBy("seq").collect()
    assert len({r["key"] for r in rows}) > 1000
    want = dict(zip((r["seq"] for r in rows), cache_replay({"key": r["key"], "profile": r["profile"]} for r in rows), strict=True))
    got = {r["seq"]: r["cached"] for r in entry.queries()["cache_hits"](spark, data).collect()}
    first = {}
    no_eviction = {r["seq"]: first.setdefault(r["key"], r["seq"]) < r["seq"] and r["profile"] == "balanced" for r in rows}
    assert got == want and want != no_eviction
    print("cached", sum(want.values()), "without eviction", sum(no_eviction.values()))


def test_every_request_is_routed(spark):
    from rodada.plans.fixtures import fixture

    got = entry.queries()["route_compare"](spark, DATA).select("id", "cycling_m", "error").collect()
    assert sorted(r["id"] for r in got) == sorted(r["seq"] for r in fixture(spark, DATA, "request").collect())
    assert all((r["cycling_m"] is None) == (r["error"] is not None) for r in got) and any(r["error"] is None for r in got)


def test_library_stands_without_the_optional_subpackage(tmp_path):
    for name in ("rodada", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for p in (ROOT / "rodada").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "rodada" / p.name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert 'edge_totals' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})

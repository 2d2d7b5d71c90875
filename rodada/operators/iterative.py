"""Loop kernels over DataFrames: connected components, bounded shortest paths, greedy independent sets.

Each round is one DAG; its result is written to the session's shared folder and read back, which cuts the lineage and
survives the loss of executors. No round brings rows to the driver, only counts. Inputs of a small, counted size are
finished by one task (components, greedy sets) or against a broadcast graph (paths); larger ones take rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.operators.work import cut, drop

#: Rows of two or three numbers that one task holds with ease.
SMALL = 1_000_000


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """Whole columns of a partition."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in names]


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of the edges, by halving label chains until nothing changes."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b):
            np.minimum.at(new, x, low)
            np.minimum.at(new, root[x], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of its component.

    Up to `small` edges are labelled by one task. Otherwise large-star and small-star rounds alternate (Kiveris et al.,
    2014): O(log^2) rounds, and no node's neighbours are ever gathered in one row, so hubs are no problem. Self-loops
    keep a node alone; ids are longs; nulls are dropped.
    """
    plain = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u is not null and v is not null")
    both_ends = cut(plain)
    if both_ends.count() <= small:

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            u, v = _columns(batches, "u", "v")
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(u, v)], names=["node", "component"])

        return both_ends.coalesce(1).mapInArrow(label, "node long, component long")
    e = cut(both_ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut(both_ends.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    drop(both_ends)
    seen = _digest(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(small_star)
        drop(old)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    root = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])


def broadcast_graph(edges: DataFrame, u: str, v: str, weights: tuple[str, ...], small: int):
    """The graph as a broadcast of sorted arrays (nodes, first edge of each, targets, weights...), or None over `small` edges."""
    if edges.count() > small:
        return None
    rows = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), *(F.col(w).cast("double").alias(f"w{k}") for k, w in enumerate(weights))).toArrow()
    source, target = rows["u"].to_numpy(), rows["v"].to_numpy()
    order = np.lexsort((target, source))
    nodes, first = np.unique(source[order], return_index=True)
    arrays = (nodes, np.append(first, len(source)), target[order], *(rows[f"w{k}"].to_numpy()[order] for k in range(len(weights))))
    return edges.sparkSession.sparkContext.broadcast(arrays)


def adjacency(arrays: tuple, k: int = 0) -> dict[int, list[tuple[int, float]]]:
    """node -> (target, weight k) of a broadcast graph."""
    nodes, first, target, *weights = arrays
    pairs = list(zip(target.tolist(), weights[k].tolist(), strict=True))
    return {n: pairs[a:b] for n, a, b in zip(nodes.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)}


def near_paths(out: dict[int, list[tuple[int, float]]], start: int, cap: float) -> dict[int, tuple[float, tuple[int, ...]]]:
    """node -> (distance, path) of all that start reaches within cap; ties go to the lexicographically smaller path."""
    best, heap, done = {start: (0.0, (start,))}, [(0.0, (start,))], {}
    while heap:
        d, path = heapq.heappop(heap)
        node = path[-1]
        if node in done:
            continue
        done[node] = (d, path)
        for to, w in out.get(node, ()):
            if to not in done and (far := round(d + w, 6)) <= cap:
                step = (far, (*path, to))
                if to not in best or step < best[to]:
                    best[to] = step
                    heapq.heappush(heap, step)
    return done


def near_distances(out: dict[int, list[tuple[int, float]]], start: int, cap: float) -> dict[int, float]:
    """node -> distance of all that start reaches within cap."""
    best, heap, done = {start: 0.0}, [(0.0, start)], {}
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = d
        for to, w in out.get(node, ()):
            if to not in done and (far := round(d + w, 6)) <= cap and far < best.get(to, float("inf")):
                best[to] = far
                heapq.heappush(heap, (far, to))
    return done


def bounded_paths(edges: DataFrame, sources: DataFrame, cap: float, targets: DataFrame | None = None, small: int = SMALL, paths: bool = True, cells: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Cheapest paths from each source: (query, node, dist, path), dist <= cap; without path, and with less work, if not paths.

    edges: (u, v, w) with w > 0. sources: (query, node). A graph of up to `small` edges is broadcast and each source is
    searched in the task that has it. A larger one is searched by cells (cells.near_paths); cells makes (node, cell),
    stretches of ids by default. Ties go to the lexicographically smaller path. targets (query, node) selects rows.
    """
    wanted = None if targets is None else targets.select("query", "node").distinct()
    graph = broadcast_graph(edges, "u", "v", ("w",), small)
    if graph is not None:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, kinds = None, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))[: 4 if paths else 3]
            for batch in batches:
                out = adjacency(graph.value) if out is None else out
                for query, node in zip(batch.column("query").to_pylist(), batch.column("node").to_pylist(), strict=True):
                    rows = [(query, n, d, path) for n, (d, path) in near_paths(out, node, cap).items()] if paths else [(query, n, d) for n, d in near_distances(out, node, cap).items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query", "node", "dist", "path"][: len(kinds)])

        spread = sources.select(F.col("query").cast("long"), F.col("node").cast("long")).distinct().repartition("query")
        found = spread.mapInArrow(search, "query long, node long, dist double" + (", path array<long>" if paths else ""))
        return found if wanted is None else found.join(wanted, ["query", "node"], "left_semi")
    from rodada.operators.cells import near_paths as near_by_cells  # which is built on what is here

    return near_by_cells(edges, sources, cap, None if cells is None else cells(), targets, paths)


def first_fit(items: DataFrame, conflicts: DataFrame, small: int = SMALL) -> DataFrame:
    """The ids that a sequential greedy pass keeps: an item goes if it conflicts with an earlier item that was kept.

    items: (id). conflicts: (later, earlier) directed pairs under the pass's order. Items without conflicts stay. Up to
    `small` conflicts are decided by one task, in order. Otherwise each round keeps every undecided item whose earlier
    partners are all gone, then drops what conflicts with the kept; the result equals the pass. Each round decides
    something, and rounds end once what is left is small.
    """
    open_ = cut(items.select("id").distinct())
    pairs = cut(conflicts.select("later", "earlier").distinct())
    kept = []
    while pairs.count() > small:
        held = pairs.select(F.col("later").alias("id")).distinct()
        free = cut(open_.join(held, "id", "left_anti"))
        kept.append(free)
        hit = cut(pairs.join(free.select(F.col("id").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("id")).distinct())
        gone = hit.unionByName(free)
        old = open_, pairs
        open_ = cut(open_.join(gone, "id", "left_anti"))
        pairs = cut(pairs.join(gone.select(F.col("id").alias("later")), "later", "left_anti").join(hit.select(F.col("id").alias("earlier")), "earlier", "left_anti"))
        drop(*old, hit)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, earlier = _columns(batches, "later", "earlier")
        before: dict[int, list[int]] = {}
        for a, b in zip(later.tolist(), earlier.tolist(), strict=True):
            before.setdefault(a, []).append(b)
        lost: set[int] = set()
        todo, order, state = [], [], {}
        for root in before:  # earlier partners first, without recursion
            todo.append(root)
            while todo:
                x = todo[-1]
                if state.get(x, 0) == 0:
                    state[x] = 1
                    todo += [y for y in before.get(x, ()) if state.get(y, 0) == 0]
                else:
                    todo.pop()
                    if state[x] == 1:
                        state[x] = 2
                        order.append(x)
        for x in order:
            if any(y not in lost for y in before.get(x, ())):
                lost.add(x)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(lost), pa.int64())], names=["id"])

    last = open_.join(pairs.coalesce(1).mapInArrow(settle, "id long"), "id", "left_anti")
    for free in kept:
        last = last.unionByName(free)
    return cut(last)

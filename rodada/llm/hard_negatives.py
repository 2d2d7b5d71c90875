"""Operator 11: hard negatives by a vector-approximation file.

The file is a table of blocks of about `block_rows` rows each. A block holds its rows' vectors, and for each dimension
up to 64 cells that its own values fill about evenly, with the smallest and largest value of each cell, and one byte a
row that names the cell. Anchors come in stripes of about `stripe` anchors. Every stripe meets every block once, in a
task of its own: for each dimension a table has the least and greatest product of the anchor with each cell, and a
row's bounds are the sums of what its cells have there. Only rows whose bounds let them enter a result are scored from
their vectors. Bounds hold for every row, so the result is exact.

Two rounds: an anchor's positives (same label, highest scores), then, for each positive, the best rows of other labels
whose score is within a window around the positive's. A block gives an anchor k rows at most, and the k best of all
blocks are the answer. Blocks and stripes are dealt by hashes of whole rows, so no label or vector makes one large.

Defined results: rows without id or label, without a vector or with a null or non-finite component take no part; rows
that repeat id, label and vector count once; rows that share an id alone are rows of their own, but never positives or
negatives of their own id; equal scores go by ascending id; shorter vectors count as filled up with zeros; empty vectors
score 0; anchors without positives, and positives without negatives, have no rows; empty tables give no rows; other
columns are ignored. Scores must fit 64 bits; larger ones raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodada.operators.work import cut

CELLS = 64
_BLOCK = "block int, dims int, ids binary, labels binary, codes binary, low binary, high binary, vectors binary"


class Approximation:
    """A block: vectors, and the cells of each dimension with the bounds of what is in them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.vectors, self.low, self.high = ids, labels, vectors, low, high
        self.codes = np.ascontiguousarray(codes.T).astype(np.intp)

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Approximation:
        """Rows go by label, so that a label's rows lie together; cells are cut at the block's own quantiles."""
        order = np.lexsort((ids, labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        n, dims = vectors.shape
        low, high, codes = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64), np.zeros((n, dims), np.uint8)
        for d in range(dims):
            values = np.sort(vectors[:, d])
            edges = np.unique(values[(np.arange(CELLS) * n) // CELLS])
            codes[:, d] = np.searchsorted(edges, vectors[:, d], side="right") - 1
            low[d, : len(edges)] = edges
            high[d, : len(edges)] = values[np.append(np.searchsorted(values, edges[1:]), n) - 1]
        return Approximation(ids, labels, vectors, codes, low, high)

    def bounds(self, anchors: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of rows a to b with each anchor: a row for each anchor."""
        most = max(1, int(np.abs(anchors).max(initial=0))) * max(1, int(np.abs(self.low).max(initial=0)), int(np.abs(self.high).max(initial=0))) * max(1, anchors.shape[1])
        kind = np.int32 if most < 2**31 else np.int64
        lower, upper = np.zeros((b - a, len(anchors)), kind), np.zeros((b - a, len(anchors)), kind)
        for d in range(anchors.shape[1]):
            x, y = np.outer(self.low[d], anchors[:, d]), np.outer(self.high[d], anchors[:, d])
            cells = self.codes[d, a:b]
            lower += np.minimum(x, y).astype(kind).take(cells, axis=0)
            upper += np.maximum(x, y).astype(kind).take(cells, axis=0)
        return np.ascontiguousarray(lower.T), np.ascontiguousarray(upper.T)

    def label_rows(self, label: int) -> tuple[int, int]:
        """Where the rows of a label begin and end."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """(-score, id) of rows."""
        scores = self.vectors[rows] @ anchor
        return [(-s, i) for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True)]

    def best(self, anchor: np.ndarray, own: int, rows: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int, window: tuple[int, int] | None = None) -> tuple[list[tuple[int, int]], int]:
        """((-score, id) of the k best of rows, scores computed): rows other than of id own, within the window if given."""
        may = self.ids[rows] != own
        sure = may
        if window:
            may = may & (upper >= window[0]) & (lower <= window[1])
            sure = may & (lower >= window[0]) & (upper <= window[1])
        if np.count_nonzero(sure) >= k:
            least = lower[sure]
            may = may & (upper >= np.partition(least, len(least) - k)[len(least) - k])
        found = self.exact(anchor, rows[may])
        kept = sorted(x for x in found if not window or window[0] <= -x[0] <= window[1])[:k]
        return kept, len(found)


def _vectors(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0) if dims is None else dims), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _rows(embeddings: DataFrame, id_col: str, label: Column, component) -> DataFrame:
    """(id, label, vector of longs) of the rows that take part, once each."""
    whole = embeddings.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").alias("v")).filter("id is not null and label is not null and v is not null")
    finite = whole.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    return finite.select("id", "label", F.transform("v", lambda x: component(x).cast("long")).alias("v")).dropDuplicates(["id", "label", "v"])


def approximation_file(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """(a row for each block, number of blocks) of rows (id, label, v)."""
    blocks = max(1, -(-rows.count() // block_rows))

    def build(table: pa.Table) -> pa.Table:
        x = Approximation.build(table["id"].to_numpy(), table["label"].to_numpy(), _vectors(table["v"].combine_chunks()))
        parts = [x.ids, x.labels, x.codes.T.astype(np.uint8), x.low, x.high, x.vectors]
        return pa.table([table["block"][:1], pa.array([x.vectors.shape[1]], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=["block", "dims", "ids", "labels", "codes", "low", "high", "vectors"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, _BLOCK), blocks


def _load(r: dict) -> Approximation:
    n, shape = len(r["ids"]) // 8, (-1, r["dims"])
    ints = lambda c: np.frombuffer(r[c], np.int64)
    return Approximation(ints("ids"), ints("labels"), ints("vectors").reshape(n, r["dims"]), np.frombuffer(r["codes"], np.uint8).reshape(n, r["dims"]), ints("low").reshape(r["dims"], CELLS), ints("high").reshape(r["dims"], CELLS)) if shape[1] else Approximation(ints("ids"), ints("labels"), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.uint8), np.zeros((0, CELLS), np.int64), np.zeros((0, CELLS), np.int64))


def _meet(file: DataFrame, blocks: int, anchors: DataFrame, n_anchors: int, stripe: int, search, schema: str) -> DataFrame:
    """search(block, rows of a stripe) for every block and every stripe of anchors (key, id, label, v, ...)."""
    stripes = max(1, -(-n_anchors // stripe))
    tasks = max(1, blocks * stripes)
    dealt = anchors.withColumn("stripe", F.pmod(F.xxhash64("key"), F.lit(stripes)).cast("int")).groupBy("stripe").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    each_block = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "block", "stripe")
    each_stripe = file.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(tasks, "block", "stripe")
    met = each_stripe.join(each_block.hint("shuffle_hash"), ["block", "stripe"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                yield from search(_load(r), r["anchors"])

    return met.mapInArrow(run, schema)


def _groups(block: Approximation, anchors: list[dict], size: int = 32) -> Iterator[tuple[list[dict], np.ndarray]]:
    """Anchors of one label at a time, a few together, with their vectors cut or filled to the block's dimensions."""
    anchors = sorted(anchors, key=lambda a: (a["label"], a["id"]))
    at = 0
    while at < len(anchors):
        to = at
        while to < len(anchors) and to < at + size and anchors[to]["label"] == anchors[at]["label"]:
            to += 1
        x = np.zeros((to - at, block.vectors.shape[1]), np.int64)
        for k, a in enumerate(anchors[at:to]):
            v = a["v"][: x.shape[1]]
            x[k, : len(v)] = v
        if x.size and np.abs(x).max() * max(1.0, float(np.abs(block.vectors).max(initial=0))) * x.shape[1] >= 2**63:
            raise ArithmeticError("scores don't fit 64 bits")
        yield anchors[at:to], x
        at = to


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def hard_negatives(embeddings: DataFrame, n_positives: int = 5, n_negatives: int = 3, low_pct: int = 50, high_pct: int = 95, is_anchor: Column | None = None, label: Column | None = None, component=lambda x: x, id_col: str = "vec_id", block_rows: int = 4096, stripe: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on `id`, label a column of embeddings, component what makes an integer of a component.
    Negatives satisfy low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score.
    """
    rows = cut(_rows(embeddings, id_col, F.col("label") if label is None else label, component))
    anchors = rows.filter(F.lit(True) if is_anchor is None else is_anchor).withColumn("key", F.xxhash64("id", "label", "v"))
    built, blocks = approximation_file(rows, block_rows)
    file, n_anchors = cut(built), anchors.count()

    def near(block: Approximation, stripe_anchors: list[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for group, x in _groups(block, stripe_anchors):
            a, b = block.label_rows(group[0]["label"])
            if a < b:
                lower, upper = block.bounds(x, a, b)
                for k, r in enumerate(group):
                    out += [(r["key"], i, -s) for s, i in block.best(x[k], r["id"], np.arange(a, b), lower[k], upper[k], n_positives)[0]]
        yield from _batch(out, ["key", "positive_id", "positive_score"])

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    positives = _meet(file, blocks, anchors, n_anchors, stripe, near, "key long, positive_id long, positive_score long").withColumn("place", place).filter(F.col("place") <= n_positives)
    asked = cut(positives.groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")).join(anchors, "key"))

    def hard(block: Approximation, stripe_anchors: list[dict]) -> Iterator[pa.RecordBatch]:
        out, everything = [], np.arange(len(block.ids))
        for group, x in _groups(block, stripe_anchors):
            a, b = block.label_rows(group[0]["label"])
            others = np.concatenate([everything[:a], everything[b:]])
            lower, upper = block.bounds(x, 0, len(everything))
            lower, upper = np.delete(lower, slice(a, b), 1), np.delete(upper, slice(a, b), 1)
            for k, r in enumerate(group):
                for p in r["positives"]:
                    score = p["positive_score"]
                    window = -(-low_pct * score // 100), high_pct * score // 100
                    if window[0] <= window[1]:
                        best, _ = block.best(x[k], r["id"], others, lower[k], upper[k], n_negatives, window)
                        out += [(r["key"], r["id"], p["positive_id"], i, score, -s) for s, i in best]
        yield from _batch(out, ["key", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _meet(file, blocks, asked, n_anchors, stripe, hard, "key long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_sql(n_positives: int = 5, n_negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> str:
    """DuckDB SQL for the rows of the registered query over embeddings."""
    return f"""WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.id % 50 = 0 AND a.id <> r.id),
 p AS (SELECT anchor, id AS positive, score AS ps FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS n FROM s WHERE same) x WHERE n <= {n_positives}),
 n AS (SELECT p.anchor, positive, ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND {low_pct} * ps <= 100 * s.score AND 100 * s.score <= {high_pct} * ps)
 SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= {n_negatives}"""

"""Hard negatives, sharding and ranked search against brute force, with odd rows, ties and forced small blocks."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rodada.llm.hard_negatives import Approximation, hard_negatives
from rodada.llm.sharding import ROW_BYTES, above, next_shift, shard_documents, write_shards
from rodada.llm.threshold_search import Segment, forward_index, term_weight, threshold_search

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string"


def _embeddings(seed, n=300, dims=8):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.3:  # copies: ties in every score
            v = rows[r.randrange(len(rows))][1]
        else:
            v = [float(np.float32(r.gauss(0.2, 0.4))) for _ in range(dims)]
        rows.append((i, v, r.choice([0, 0, 0, 1, 2]), "x", "y"))
    odd = [(1000, None, 1), (1001, [0.1, None] + [0.0] * 6, 1), (1002, [float("nan")] + [0.1] * 7, 0), (1003, [float("inf")] * 8, 0), (1004, [0.5] * 8, None), (None, [0.5] * 8, 1), (1050, [], 0), (1006, [0.9] * 3, 2), (1100, [0.2] * 8, 77)]
    return rows + [(*x, "a", "b") for x in odd] + rows[:5]


def _plain_negatives(rows, n_pos, n_neg):
    ok = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[(i, label, tuple(v))] = [math.floor(256 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for (i, label, _), v in ok.items():
        if i % 10:
            continue
        scored = sorted((-dot(v, w), j, other) for (j, other, _), w in ok.items() if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            found = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_neg]
            out.update((i, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(found))
    return out


@pytest.mark.parametrize(("seed", "block", "stripe"), [(1, 4096, 1024), (2, 40, 7), (3, 7, 3)])
def test_hard_negatives_equal_brute_force(spark, seed, block, stripe):
    rows = _embeddings(seed)
    random.Random(seed).shuffle(rows)
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), n_positives=4, n_negatives=3, is_anchor=F.col("id") % 10 == 0, component=lambda x: F.floor(x.cast("double") * 256), block_rows=block, stripe=stripe)
    assert Counter(tuple(r) for r in got.collect()) == _plain_negatives(rows, 4, 3)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives(none).collect() == [] and hard_negatives(spark.createDataFrame([(0, [0.5], 1, "", "")], VECTORS)).collect() == []


def test_bounds_hold_and_most_rows_are_not_scored():
    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(size=(4000, 64)) / 8).astype(np.int64)
    block = Approximation.build(np.arange(4000), r.integers(0, 2, 4000), v)
    anchors = block.vectors[:40]
    lower, upper = block.bounds(anchors, 0, 4000)
    exact = anchors @ block.vectors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    wide, _ = block.bounds(anchors * 2**20, 0, 4000)
    assert (wide <= exact * 2**20).all()
    a, b = block.label_rows(0)
    best, scored = block.best(anchors[3], -1, np.arange(a, b), lower[3, a:b], upper[3, a:b], 5)
    assert best == sorted(block.exact(anchors[3], np.arange(a, b)))[:5] and scored < (b - a) / 10


DOCS = "doc_id long, text string, size string, shard string, _h string"


def _documents(seed, n=400):
    r = random.Random(seed)
    word = lambda: "w%d" % int(r.expovariate(0.05))
    text = lambda: " ".join(word() for _ in range(r.randint(1, 60)))
    copy = text()
    rows = [(i, copy if r.random() < 0.33 else text()) for i in range(n)]
    rows += [(None, copy), (None, "w1 w2"), (5000, None), (5001, ""), (5002, "é ñ Ü"), (-7, "W1 w2 W3"), rows[0], rows[0], (5003, "long w1 " * 3000)]
    r.shuffle(rows)
    return [(*x, "a", "b", "c") for x in rows]


@pytest.mark.parametrize(("shards", "tolerance"), [(40, 0.01), (7, 0.0), (7, 0.3), (1, 0.01), (600, 0.01)])
def test_shards_are_ranges_of_near_equal_bytes(spark, shards, tolerance):
    rows = _documents(shards)
    got = shard_documents(spark.createDataFrame(rows, DOCS), shards, tolerance, keep=("text", "shard", "_h")).collect()
    size = lambda t: len((t or "").encode()) + ROW_BYTES
    assert Counter((r["doc_id"], r["text"], r["shard_in"], r["_h_in"]) for r in got) == Counter((x[0], x[1], "b", "c") for x in rows)
    assert all(r["size"] == size(r["text"]) and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards)) and all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by.values())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    off = 0
    for j in range(shards - 1):  # each boundary is as near to its share as the tolerance or the document on it allows
        off += sum(r["size"] for r in by[j])
        assert abs(off - (j + 1) * total / shards) <= max(tolerance * total / shards, largest / 2)
    cut = [t for t, n in Counter(r["text"] or "" for r in got).items() if n > 1 and len({r["shard"] for r in got if (r["text"] or "") == t}) > 1]
    assert len(cut) <= 1 or not tolerance or shards == 600  # the hot text alone, unless two copies are more than the tolerance


def test_hot_copies_are_divided_by_id_and_identical_rows_by_place(spark):
    rows = [(i, "same", "", "", "") for i in range(-500, 500)] + [(3, "twin", "", "", "")] * 1000
    got = shard_documents(spark.createDataFrame(rows, DOCS), 8, 0.0).collect()
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1


def test_splitter_arithmetic():
    assert next_shift(0, 255) == 0 and next_shift(0, 256) == 8 and next_shift(-1, 0) == 56 and next_shift(5, 4) == 0
    assert above((3, 2**63)) == (4,) and above((3, 5)) == (3, 5) and above((2**63,)) == ()


def test_shards_of_nothing_and_files(spark, tmp_path):
    assert shard_documents(spark.createDataFrame([], DOCS)).collect() == []
    rows = _documents(2, 50)
    write_shards(spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/out", 5)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"], r["size_in"]) for r in back.collect()) == Counter(x[:3] for x in rows)
    assert {r["shard"] for r in back.collect()} <= set(range(5))  # the long document takes the room of two


def _plain_search(docs, items, k):
    words = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    held = [(d[0], Counter(words(d[1]))) for d in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t, *_ in items if i is not None and t is not None}:
        scored = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_words
            s = sum(term_weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out.update((item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k]))
    return out


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"step": 1, "segment_postings": 200}), (3, {"max_terms": 5, "step": 3, "k": 3})])
def test_search_equals_brute_force(spark, seed, options):
    r, docs = random.Random(seed), _documents(seed, 200)
    items = [(i, " ".join("W%d" % int(r.expovariate(0.05)) for _ in range(r.randint(1, 30))), "x") for i in range(12)] + [(50, None, ""), (51, ""    , ""), (None, "w1", ""), (52, "zzz unknown", ""), (53, "w1 w1 w2", ""), (53, "w1 w1 w2", ""), (53, "w3", ""), (54, docs[3][1], "")]
    got = threshold_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string, score string"), **options)
    assert Counter(tuple(x) for x in got.collect()) == _plain_search(docs, items, options.get("k", 10))


def test_search_of_nothing(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert threshold_search(none, items).collect() == []
    some = spark.createDataFrame(_documents(1, 5), DOCS)
    assert threshold_search(some, items.filter("item_id = 2")).collect() == []
    assert threshold_search(some.filter("text is null"), items).collect() == []


def test_search_stops_before_the_ends_of_the_lists(spark):
    r = np.random.default_rng(1)
    n = 20_000
    tf = r.integers(1, 40, n * 2)
    segment = Segment(np.arange(n), np.full(n, 100), np.full(n, 2), np.tile([0, 1], n).astype(np.int32), tf, np.array([500, 900]), n, n * 100)
    best, depth = segment.search([(0, 1), (1, 2)], [], 10, 64, np.array([1, 2]))
    scores = segment.scores(np.arange(n), np.array([1, 2]))
    assert best == sorted(zip((-scores).tolist(), range(n), strict=True))[:10] and depth < n / 4


def test_long_text_is_read_to_its_end(spark):
    docs = spark.createDataFrame([(1, "w2 " * 400_000 + "needle"), (2, "w2 other")], "doc_id long, text string")
    got = threshold_search(docs, spark.createDataFrame([("a", "Needle")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("a", 1, 1)]
    place = spark.sparkContext.broadcast({b"w2": 0})
    assert [r["n"] for r in forward_index(docs, place, "doc_id", "text").orderBy("doc_id").collect()] == [400_001, 2]

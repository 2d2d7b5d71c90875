"""Near-duplicate components and repeated-string removal against brute force, with hot groups forced through blocks."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from rodada.llm import suffix_dedup
from rodada.llm.ngram_join import CellIndex, Shingler, bitmap, jaccard_components, jaccard_sql, link_cell, merged, promising
from rodada.llm.suffix_dedup import anchors, gram_hashes, joined, remove_repeats, repeated_windows, union

SCHEMA = "doc_id long, text string, n long, lead string"


def _corpus(seed, n=60):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = text(70), text(120)
    out = [None, "", " \n ", "a b", "a  B", "A b c", "é" * 300, "x " * 500, base, base]
    for _ in range(n):
        kind = r.random()
        if kind < 0.5:  # near copies
            w = base.split(" ")
            for _ in range(r.randint(1, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        elif kind < 0.75:
            out.append(f"{text(r.randint(5, 60))} {passage} {text(r.randint(5, 60))}")
        else:
            out.append(text(r.randint(1, 90)))
    return [(i * 5 % 1009, t, 1, "x") for i, t in enumerate(out)]


def _components(rows):
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())) for i, w in words]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("cap", "rounds"), [(512, 2), (4, 2), (4, 0), (2, 1)])
def test_jaccard_components(spark, cap, rounds):
    rows = _corpus(cap)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, cell_cap=cap, pivots=1, rounds=rounds, wide=1).collect()}
    assert got == _components(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {i: (n, c) for i, n, c in con.execute(jaccard_sql()).fetchall()} == _components(rows)


def test_components_of_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(empty).count() == 0
    rows = [(5, "a b c d e f", 1, ""), (5, "a b c d e f", 1, ""), (2, "a b c d e f", 1, ""), (9, None, 1, "")]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (9, 0, 9)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_unrelated_documents_that_share_a_passage(spark, rounds):
    """A cell of classes without links: the sample is too small to show what they share."""
    r = random.Random(44)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = words(12)
    rows = [(i, f"{words(25)} {passage}", 1, "") for i in range(60)]
    rows += [(100 + k, rows[7 * k][1] + " end", 1, "") for k in range(5)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, SCHEMA), cell_cap=6, pivots=1, sample_docs=1, rounds=rounds, wide=1).collect()}
    assert got == {i: 7 * (i - 100) if i >= 100 else i for i, *_ in rows}


def test_very_long_texts_and_rows_without_id(spark):
    r = random.Random(31)
    long_ = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = [*long_]
    for k in r.sample(range(60_000), 300):
        near[k] = "other"
    rows = [(1, " ".join(long_), 1, ""), (2, " ".join(near), 1, ""), (3, " ".join(long_[:30_000]), 1, ""), (None, " ".join(long_), 1, ""), (None, "alone here", 1, "")]
    got = {(x["doc_id"], x["n_shingles"]): x["component_id"] for x in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [v for (i, _), v in sorted(got.items(), key=str) if i in (1, 2, 3)] == [1, 1, 3] and len(got) == 5
    assert got[None, 1] is None and sorted(v for (i, n), v in got.items() if i is None and n > 1) == [1]
    kept = {x["doc_id"]: x["n_removed"] for x in remove_repeats(spark.createDataFrame([*rows[2:4], (9, " ".join(long_[100:200]), 1, "")], SCHEMA)).collect()}
    assert sorted(kept) == [3, 9] and kept[9] == len(" ".join(long_[100:200]))


def test_cell_search_finds_all_links():
    r = np.random.default_rng(3)
    for t in range(60):
        core = r.integers(0, 10**9, 60).astype(np.uint64)
        sets = []
        for _ in range(25):
            keep = core[r.random(60) < r.choice([0.85, 0.93, 0.5])]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 10**9, int(r.integers(0, 9))).astype(np.uint64)])))
        sets = [s for s in sets if len(s)]
        index = CellIndex(sets, 80, mu=[0.0085, 0.5][t % 2])
        like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        pairs = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and like(sets[i], sets[j])}
        assert {(q, int(x)) for q in range(len(sets)) for x in index.query(q)} == pairs
        root = list(range(len(sets)))
        for a, b in link_cell(sets, 80):
            assert (a, b) in pairs
            old, new = root[b], root[a]
            root = [new if x == old else x for x in root]
        assert all(root[a] == root[b] for a, b in pairs)
        keep = promising([len(s) for s in sets], [bitmap(s) for s in sets], 80)  # bitmaps must not rule out a linked member
        assert all(keep[a] and keep[b] for a, b in pairs)
        asked = r.random(len(sets)) < 0.3
        keep = promising([len(s) for s in sets], [bitmap(s) for s in sets], 80, asked.tolist())
        assert all(keep[a] and keep[b] for a, b in pairs if asked[a] or asked[b])


def test_bitmaps_of_different_widths():
    r = np.random.default_rng(4)
    for _ in range(40):
        n = int(r.integers(100, 140))  # widths change at 128
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.85, 1))], r.integers(0, 2**63, int(r.integers(0, 20))).astype(np.uint64)]))
        like = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        keep = promising([len(a), len(b)], [bitmap(a), bitmap(b)], 80)
        assert keep[0] == keep[1] and (keep[0] or not like)
    far = [np.unique(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(30)]
    assert not promising([len(x) for x in far], [bitmap(x) for x in far], 80).any()


def test_heap_merge_counts():
    r = random.Random(8)
    for _ in range(50):
        lists = [sorted(r.sample(range(12), r.randint(1, 8))) for _ in range(r.randint(1, 6))]
        weights, least = [r.randint(1, 3) for _ in lists], r.randint(1, 5)
        total = Counter()
        for x, w in zip(lists, weights, strict=True):
            total.update(dict.fromkeys(x, w))
        found, counts = merged(lists, weights, least)
        assert list(zip(found, counts, strict=True)) == sorted((k, v) for k, v in total.items() if v >= least)


def test_shingles():
    s = Shingler()
    assert len(s(None)) == len(s("")) == len(s(" \t\n")) == 0
    assert len(s("a b")) == 1 and (s("A  b") == s("a b")).all() and len(s("a b c d e f")) == 2
    assert len(s("É x")) == 1 and (s("É x") != s("é x")).all()


def _removal(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.fixture()
def limits(monkeypatch):
    """Sets the module's limits for the driver and, through the closures that it sends, for the workers."""

    def put(**values):
        for name, value in values.items():
            monkeypatch.setattr(suffix_dedup, name, value)

    return put


@pytest.mark.parametrize(("block", "size", "stretch"), [(1 << 20, 1 << 18, 1 << 16), (600, 1 << 18, 1 << 16), (1 << 20, 500, 1 << 16), (600, 500, 300)])
def test_removal(spark, limits, block, size, stretch):
    limits(BLOCK_BYTES=block, SLICE=size, STRETCH=stretch, FAN=2)
    rows = _corpus(block + size, 40)
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == _removal(rows, 200)


def test_a_leader_of_many_blocks_is_copied_by_many_tasks(spark):
    from pyspark.sql import functions as F

    pieces = spark.createDataFrame([(7, -1, 100_000, b"x"), (8, -1, 300, b"y")], "cell long, block int, n int, bytes binary")
    got = suffix_dedup.fanned(pieces, 16).withColumn("task", F.spark_partition_id())
    counts = {r["cell"]: (r["n"], r["blocks"], r["top"], r["tasks"]) for r in got.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.max("block").alias("top"), F.count_distinct("task").alias("tasks")).collect()}
    assert counts[7] == (100_000, 100_000, 99_999, 16) and counts[8][:3] == (300, 300, 299) and counts[8][3] >= 1
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 15_000


def test_removal_of_empty_and_repeated_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "ab" * 150, 1, ""), (1, "ab" * 150, 1, ""), (2, None, 1, ""), (3, "é" * 120, 1, ""), (4, "short", 1, "")]
    got = sorted(tuple(r) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == _removal(rows, 200)
    text = remove_repeats(spark.createDataFrame(rows, SCHEMA), with_text=True).filter("doc_id = 4").first()["kept"]
    assert text == "short"


def test_repeated_windows_and_groups():
    r = random.Random(2)
    for _ in range(120):
        length = r.choice([3, 5, 8, 20])
        base = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(3)]
        pieces = [np.frombuffer(b"".join(r.choice(base)[r.randint(0, 20) :] for _ in range(r.randint(1, 3))) or b"a", np.uint8) for _ in range(r.randint(1, 10))]
        windows = [[bytes(p[i : i + length]) for i in range(max(0, len(p) - length + 1))] for p in pieces]
        count = Counter(w for x in windows for w in x)
        flags, groups = repeated_windows(pieces, length, True)
        assert [f.tolist() for f in flags] == [[count[w] > 1 for w in x] for x in windows]
        named: dict = {}
        for g, x, f in zip(groups, windows, flags, strict=True):
            for k, w in enumerate(x):
                if f[k]:
                    assert named.setdefault(int(g[k]), w) == w


def test_anchors_and_pieces():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"abc") for _ in range(400)), np.uint8)
    at, h = anchors(data, 20, 6)
    assert (gram_hashes(data, 6)[at] == h).all()
    assert all(((at >= k) & (at <= k + 14)).any() for k in range(len(data) - 19))
    later = np.concatenate([np.frombuffer(b"zz", np.uint8), data])
    assert set(at.tolist()) <= set((anchors(later, 20, 6)[0] - 2).tolist())
    assert union([(5, 9), (1, 3), (3, 5), (20, 21)]) == [(1, 9), (20, 21)]
    text = bytes(range(256)) * 30
    pieces = list(joined([(0, text[:3000]), (2500, text[2500:7000]), (9, text[9:40])], 200))
    starts = [at + k for at, p in pieces for k in range(len(p) - 199)]
    assert starts == list(range(7000 - 199)) and all(text[at : at + len(p)] == p for at, p in pieces)


def test_shingles_of_many_texts_are_those_of_each():
    from rodada.llm.ngram_join import PIECE

    r = random.Random(11)
    strings = [None, "", " \n", "a", "A b\x0bc", "é ü z q w e r", "x" * 70, "y" * (3 * PIECE) + " b c d e f " + "w " * PIECE, "q" * (PIECE - 1), "q" * PIECE, ("ab cd " * PIECE)[: 2 * PIECE + 5]]
    strings += [" ".join(r.choice(["al", "be", "ga", "x" * 66]) for _ in range(r.randrange(9))) for _ in range(100)]
    seen = {}
    for s, got in zip(strings, Shingler().many(strings), strict=True):
        words = (s or "").encode().lower().split()
        k = min(5, len(words))
        want = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        assert len(want) == len(got) and np.array_equal(got, Shingler()(s)) and np.array_equal(got, np.unique(got))
        assert seen.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
    assert len(set(seen.values())) == len(seen)

"""Operator 4: n-gram Jaccard join by T-occurrence search, and the components of its links.

Steps, all of them exact for the threshold:

1. Every whole text becomes its set of word shingles (64-bit hashes). Equal sets form a class, named by its smallest
   doc_id; from here on only classes count, so copies are never expanded into pairs.
2. Each class emits the prefix of its set (n - ceil(t*n) + 1 shingles) in one global order: frequent shingles last, then
   by hash. Two sets that reach the threshold share a prefix shingle. What is frequent is guessed from a bounded sample;
   that changes the work, never the result. The smallest class of a shingle leads the cell of all classes that have it
   in their prefix; two linked classes are together in at least one cell. No step gathers a shingle's rows: a minimum,
   and a join that can split skew.
3. Cells over `cell_cap` classes are dealt to blocks, with some members of the cell repeated in each block as pivots.
   A member brings a parity bitmap of its whole set: two bitmaps differ in no more places than the sets differ in
   shingles, which bounds their overlap. Members of a block that can't reach the threshold with any other are dropped,
   so whole sets are only moved for likely links.
4. Each block is searched: an inverted index over its sets, and for a query set the T-occurrence problem solved the
   DivideSkip way: the longest lists are put aside, the short ones are merged by a heap that counts occurrences, and
   what can still reach T is looked up in the long lists by binary search; what reaches T is compared exactly. Lists
   with the same members are one list with a weight. Only connectivity is asked for, so a member needs no query once
   all members that weren't queried are in one component.
5. After the components are known, a second pass compares the members that aren't in a hot cell's main component with
   all of its blocks: first bitmaps, then the sets of what is left. No link between different components of a cell stays
   unseen, and no task holds more than two blocks and the pivots. If such members are more than `wide` blocks, unrelated
   documents share a passage that the sample didn't show. Then all of the cell's classes take part in a pass of their
   own, in which the shingles that make large cells, counted over all prefixes, go last; up to `rounds` times.
6. Components of the links, by large-star/small-star rounds.

Defined results: null, empty or blank texts have no shingles and are linked with nothing (their component is their own
doc_id); texts with fewer than `size` words have one shingle; rows that share a doc_id are one node and give a row each;
rows without doc_id lead nothing, and get the component of their set's class, or none; empty tables no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.common import kept, n_rows_at_most, texts
from rodada.operators.iterative import connected_components
from rodada.operators.work import cut, drop

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Up to so many classes are broadcast (about 64 MB), so that only their texts are shuffled; beyond, all texts are.
BROADCAST_CLASSES = 2_000_000
#: Bytes that are hashed at once, and the longest word that is hashed byte by byte.
PIECE, LONG = 1 << 17, 64
_BLANK = re.compile(rb"[ \t-\r]")


def _mixed(x: np.ndarray) -> np.ndarray:
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts' shingle sets as sorted arrays of 64-bit hashes.

    The words of many texts are hashed at once. With a random number for each byte value, sums of number * base^place
    over all bytes are kept; a word's hash is the difference of two such sums, moved to place 0, mixed with its length.
    """

    def __init__(self, size: int = 5):
        self.size = size
        base = 0x9E3779B97F4A7C15
        places = [np.full(2 * PIECE, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for p in places:
            p[0] = 1
        self.up, self.down = (np.multiply.accumulate(p) for p in places)
        self.number = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(base))
        self.blank = np.zeros(256, np.bool_)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the words of at most 2 * PIECE bytes."""
        import xxhash

        at = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(at) + 2, np.int8)
        inside[1:-1] = ~self.blank[at]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(self.number[at] * self.up[: len(at)], out=total[1:])
        length = end - start
        h = _mixed((total[end] - total[start]) * self.down[start] + length.astype(np.uint64))
        for k in np.flatnonzero(length > LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
        return start, h

    def _long(self, data: bytes) -> np.ndarray:
        """Hashes of the words of any number of bytes."""
        import xxhash

        found, at = [], 0
        while at < len(data):
            stop = _BLANK.search(data, at + PIECE)
            end = stop.start() if stop else len(data)
            if end - at <= 2 * PIECE:
                found.append(self.words(data[at:end])[1])
            else:  # a word as long as that
                found += [np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) if len(w) > LONG else self.words(w)[1] for w in data[at:end].split()]
            at = end
        return np.concatenate(found)

    def _windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k neighbouring words."""
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out += h[j : len(h) - k + 1 + j] * (_MIX[j % 8] + np.uint64(2 * (j // 8)))
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def _set(self, h: np.ndarray) -> np.ndarray:
        return np.unique(self._windows(h, min(self.size, len(h)))) if len(h) else h

    def _together(self, texts_: list[bytes]) -> Iterator[np.ndarray]:
        """The sets of texts that are at most 2 * PIECE bytes with a blank behind each."""
        start, h = self.words(b" ".join(texts_))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts_)])).tolist()
        wide = self._windows(h, self.size) if len(h) >= self.size else h[:0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(wide[a : b - self.size + 1]) if b - a >= self.size else self._set(h[a:b])

    def many(self, strings: list[str | None]) -> Iterator[np.ndarray]:
        """The set of each text, in order; none has no words."""
        near, n = [], 0
        for s in strings:
            data = (s or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z and ASCII blanks
            if near and n + len(data) + 1 > PIECE:
                yield from self._together(near)
                near, n = [], 0
            if len(data) >= PIECE:
                yield self._set(self._long(data))
            else:
                near.append(data)
                n += len(data) + 1
        if near:
            yield from self._together(near)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.many([text]))


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def merged(lists: list[list[int]], weights: list[int], least: int) -> tuple[list[int], list[int]]:
    """The members whose lists weigh `least` or more, and the weights: a heap of the ascending lists' heads."""
    heads = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapify(heads)
    found, totals = [], []
    while heads:
        member, total = heads[0][0], 0
        while heads and heads[0][0] == member:
            _, k, place = heads[0]
            total += weights[k]
            place += 1
            if place < len(lists[k]):
                heapreplace(heads, (lists[k][place], k, place))
            else:
                heappop(heads)
        if total >= least:
            found.append(member)
            totals.append(total)
    return found, totals


class CellIndex:
    """Inverted index over a block's sets, with DivideSkip T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int, mu: float = 0.0085):
        self.sets, self.percent, self.mu = sets, percent, mu
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        length = np.diff(np.append(first, len(values)))
        self.popular = np.bincount(self.owner, weights=np.repeat(length, length), minlength=len(sets))
        keep = length > 1  # a list of one holds nobody but the query
        self.shingle, first, length = values[first[keep]], first[keep], length[keep]
        # lists with the same members: sorted by length and the bytes of their members
        names: dict[bytes, int] = {}
        self.group = np.array([names.setdefault(self.owner[a : a + n].tobytes(), len(names)) for a, n in zip(first.tolist(), length.tolist(), strict=True)], np.int64)
        self.lists = [np.frombuffer(x, np.int64) for x in names]
        self.length = np.array([len(x) for x in self.lists], np.int64)

    def query(self, q: int) -> np.ndarray:
        """Members, other than q, whose similarity with q reaches the threshold."""
        s, n = self.sets[q], int(self.sizes[q])
        t = needed(n, self.percent)
        at = np.searchsorted(self.shingle, s)
        inside = at < len(self.shingle)
        at, s = at[inside], s[inside]
        at = at[self.shingle[at] == s]
        if len(at) < t:
            return at[:0]
        group, weight = np.unique(self.group[at], return_counts=True)
        order = np.argsort(-self.length[group], kind="stable")  # the longest first
        group, weight = group[order], weight[order]
        aside = min(t - 1, int(t / (self.mu * np.log2(int(self.length[group[0]]) + 1) + 1)))
        total = np.cumsum(weight)
        cut_at = int(np.searchsorted(total, aside, side="right"))  # groups that are put aside, all of each
        left = int(total[cut_at - 1]) if cut_at else 0
        found, overlap = (np.array(x, np.int64) for x in merged([self.lists[g].tolist() for g in group[cut_at:].tolist()], weight[cut_at:].tolist(), t - left))
        fits = (found != q) & (self.sizes[found] * 100 >= n * self.percent) & (self.sizes[found] * self.percent <= n * 100)
        found, overlap = found[fits], overlap[fits]
        for k in range(cut_at):
            if not len(found):
                break
            posting = self.lists[group[k]]
            hit = np.searchsorted(posting, found)
            overlap = overlap + weight[k] * (posting[np.minimum(hit, len(posting) - 1)] == found)
            left -= int(weight[k])
            if k % 16 == 15:  # out of reach even if all lists that are left hold it
                open_ = overlap + left >= t
                found, overlap = found[open_], overlap[open_]
        return found[100 * overlap >= self.percent * (n + self.sizes[found] - overlap)]


def link_cell(sets: list[np.ndarray], percent: int, asked: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the cell's links connect. With asked: all links of the members asked for."""
    index = CellIndex(sets, percent)
    n, links = len(sets), []
    if asked is not None:
        return [(q, int(x)) for q in range(n) if asked[q] for x in index.query(q)]
    root = np.arange(n)
    waiting = np.ones(n, np.bool_)
    by_size = np.argsort(-index.popular, kind="stable")
    while True:
        left = by_size[waiting[by_size]]
        groups, counts = np.unique(root[left], return_counts=True)
        if len(groups) < 2:
            return links
        # the first query goes to the most popular member; then to those outside the largest waiting component
        q = int(left[0] if waiting.all() else left[root[left] != groups[np.argmax(counts)]][0])
        waiting[q] = False
        for x in index.query(q).tolist():
            if root[x] != root[q]:
                links.append((q, x))
                root[root == root[x]] = root[q]


def star_links(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked member with the first of its component: what the links connect, in one step."""
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        top = x
        while root[top] != top:
            top = root[top]
        if top != x:
            out.append((top, x))
    return out


def ordered(shingles: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles' order keys, ascending: frequent ones (in the sorted array late) after all others, then by hash."""
    key = shingles >> np.uint64(1)
    if len(late):
        at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
        key = key | ((late[at] == shingles).astype(np.uint64) << np.uint64(63))
    return np.sort(key)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, 256 to 8192 bits by its size: bit j tells whether an odd number of shingles fall on j."""
    width = min(8192, max(256, 1 << (2 * len(shingles)).bit_length()))
    place = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(width - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def promising(sizes: list[int], bitmaps: list[np.ndarray], percent: int, asked: list[bool] | None = None) -> np.ndarray:
    """Which members may be linked, judged by their bitmaps; with asked, by a link that one of the asked has.

    A bitmap is folded to the narrower one's width by adding its halves modulo 2. Two bitmaps then differ in no more
    places than the sets in shingles, so the overlap is at most half of what both sizes leave of that.
    """
    n, words = np.array(sizes, np.int64), np.array([len(b) for b in bitmaps])
    wanted = np.ones(len(n), np.bool_) if asked is None else np.array(asked, np.bool_)
    out = np.zeros(len(n), np.bool_)
    for width in np.unique(words).tolist():
        who = np.flatnonzero(words >= width)
        table = np.array([np.bitwise_xor.reduce(bitmaps[k].reshape(-1, width), axis=0) for k in who.tolist()])
        for row in np.flatnonzero(words[who] == width).tolist():
            q = who[row]
            apart = np.bitwise_count(table ^ table[row]).sum(axis=1, dtype=np.int64)
            both = n[who] + n[q]
            ok = ((both - apart) // 2 >= -(-percent * both // (100 + percent))) & (n[who] * 100 >= n[q] * percent) & (n[who] * percent <= n[q] * 100)
            ok[row] = False
            if not wanted[q]:
                ok &= wanted[who]
            if ok.any():
                out[q] = True
                out[who[ok]] = True
    return out


def _sets(docs: DataFrame, size: int, percent: int, heavy) -> DataFrame:
    """doc_id, n, k1, k2 (hash of the set), prefix (order keys, ascending), bits (bitmap)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, late = kept(Shingler, size), heavy.value
        for batch in batches:
            for rows, strings in texts(batch, "text"):
                n, k1, k2, prefix, bits = [], [], [], [], []
                for x in shingles.many(strings):
                    n.append(len(x))
                    digest = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8")
                    k1.append(int(digest[0]))
                    k2.append(int(digest[1]))
                    bits.append(bitmap(x).tobytes() if len(x) else b"")
                    if len(x):
                        x = ordered(x, late)[: len(x) - needed(len(x), percent) + 1]
                    prefix.append(x.view(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), arrays, pa.array(bits, pa.binary())], names=["doc_id", "n", "k1", "k2", "prefix", "bits"])

    return docs.mapInArrow(emit, "doc_id long, n long, k1 long, k2 long, prefix array<long>, bits binary")


def _frequent(docs: DataFrame, size: int, sample_docs: int, least: int, most: int) -> np.ndarray:
    """Shingles that at least `least` documents of a sample have: `most` at most, so the broadcast is bounded."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(Shingler, size)
        for batch in batches:
            for _, strings in texts(batch, "text"):
                found, n = np.unique(np.concatenate(list(shingles.many(strings))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    sample = n_rows_at_most(docs, sample_docs, seed=4)
    top = sample.select("text").mapInArrow(emit, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most)
    return np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64).view(np.uint64))


def _links(source: DataFrame, firsts: DataFrame, late: np.ndarray, known: DataFrame | None, rounds: int, size: int, percent: int, cell_cap: int, pivots: int, most: int, wide: int) -> DataFrame:
    """Links (src, dst) that, with the known ones, connect what is linked among the classes firsts (cls, n, prefix, bits)."""
    keys = firsts.select("cls", F.explode("prefix").alias("h"))
    leaders = cut(keys.groupBy("h").agg(F.min("cls").alias("lead"), F.max("cls").alias("last"), F.count("*").alias("m")).filter("lead < last").select("h", "lead", "m"))
    cells = cut(keys.join(leaders.select("h", "lead"), "h").select("lead", "cls").distinct())
    sizes = cut(cells.groupBy("lead").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / cell_cap).cast("int")))
    hot = cut(cells.join(sizes.filter("blocks > 1"), "lead"))
    place = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    is_pivot = F.pmod(F.xxhash64(F.lit(7), F.col("cls")), F.col("m")) < pivots
    blocks = F.when(is_pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(place))
    work = hot.select("cls", "lead", F.explode(blocks).alias("block")).unionByName(cells.join(sizes.filter("blocks = 1").select("lead"), "lead").select("cls", "lead", F.lit(0).alias("block")))
    about = firsts.select("cls", "n", "bits")
    likely = cut(_likely(work.withColumns({"portion": F.lit(0), "asked": F.lit(False)}).join(about.hint("shuffle_hash"), "cls"), percent, False))
    drop(cells, sizes)
    found = _search_cells(source, likely, size, percent, False)
    links = cut((found if known is None else found.unionByName(known)).distinct())
    drop(likely)
    if hot.isEmpty():
        drop(hot, leaders)
        return links
    parts = connected_components(links, small=0)
    dealt = hot.withColumn("block", place)
    labelled = dealt.join(parts, dealt["cls"] == parts["node"], "left").select("cls", "lead", "block", "blocks", F.coalesce("component", "cls").alias("component"))
    counts = labelled.groupBy("lead", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("lead").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    labelled = cut(labelled.join(main, "lead"))
    outside = labelled.filter("component <> main")
    portions = cut(outside.groupBy("lead").agg(F.ceil(F.count("*") / cell_cap).cast("int").alias("portions")))
    now = portions if rounds == 0 else portions.filter(F.col("portions") <= wide)
    if not now.isEmpty():
        asking = outside.join(now, "lead").select("cls", "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(9), F.col("cls")), F.col("portions")).cast("int").alias("portion"), F.lit(True).alias("asked"))
        members = labelled.join(now, "lead").select("cls", "lead", "block", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(False).alias("asked"))
        pairs = cut(_likely(asking.unionByName(members).join(about.hint("shuffle_hash"), "cls"), percent, True))
        old, links = links, cut(links.unionByName(_search_cells(source, pairs, size, percent, True)).distinct())
        drop(old, pairs)
    if rounds > 0 and not (unsettled := portions.filter(F.col("portions") > wide)).isEmpty():
        often = leaders.filter((F.col("m") > cell_cap) & (F.col("h") >= 0)).orderBy(F.desc("m"), "h").limit(most).select("h")  # the sign marks what is last
        found_often = np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64) << np.uint64(1)
        # an order key lacks the hash's last bit: both shingles that it may stand for go last
        late = np.union1d(late, np.concatenate([found_often, found_often | np.uint64(1)]))
        again = labelled.join(unsettled.select("lead"), "lead", "left_semi").select("cls").distinct()
        sets = _sets(source.join(again.select(F.col("cls").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi"), size, percent, source.sparkSession.sparkContext.broadcast(late))
        anew = cut(sets.withColumnRenamed("doc_id", "cls").join(firsts.select("cls", "k1", "k2"), ["cls", "k1", "k2"], "left_semi").select("cls", "k1", "k2", "n", "prefix", "bits"))
        old, links = links, _links(source, anew, late, links, rounds - 1 if len(found_often) else 0, size, percent, cell_cap, pivots, most, wide)
        drop(old, anew)
    drop(hot, leaders, labelled, portions)
    return links


def _likely(rows: DataFrame, percent: int, asked: bool) -> DataFrame:
    """The rows (lead, block, portion, asked, cls, n, bits) of a block that bitmaps don't rule out, without n and bits."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["lead", "block", "portion", "cls", "asked"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                members, flags = list(held), list(held.values())
                keep = promising([m[1] for m in members], [np.frombuffer(m[2], np.uint64) for m in members], percent, flags if asked else None)
                chosen = [(*key, m[0], f) for m, f, k in zip(members, flags, keep.tolist(), strict=True) if k]
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chosen, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for *k, cls, flag, n, bits in zip(*(batch.column(c).to_pylist() for c in (*names, "n", "bits")), strict=True):
                if k != key:
                    yield from done()
                    key, held = k, {}
                held[cls, n, bits] = flag or held.get((cls, n, bits), False)
        yield from done()

    together = rows.select(*names, "n", "bits").repartition(parts, "lead", "block", "portion").sortWithinPartitions("lead", "block", "portion")
    return together.mapInArrow(judge, "lead long, block int, portion int, cls long, asked boolean")


def _search_cells(docs: DataFrame, work: DataFrame, size: int, percent: int, asked: bool) -> DataFrame:
    """Links (src, dst) from work rows (cls, lead, block, portion, asked): each (lead, block, portion) is one search."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for_doc = work.groupBy("cls").agg(F.collect_list(F.struct("lead", "block", "portion", "asked")).alias("jobs"))
    sources, there = docs.select(F.col("doc_id").alias("cls"), "text"), work.select("cls").distinct()
    if there.count() <= BROADCAST_CLASSES:
        sources = sources.join(F.broadcast(there), "cls", "left_semi")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(Shingler, size)
        schema = pa.schema([("lead", pa.int64()), ("block", pa.int32()), ("portion", pa.int32()), ("asked", pa.bool_()), ("cls", pa.int64()), ("members", pa.binary())])
        for batch in batches:
            for rows, strings in texts(batch, "text", 128):
                out = []
                for x, cls, jobs in zip(shingles.many(strings), rows.column("cls").to_pylist(), rows.column("jobs").to_pylist(), strict=True):
                    members = x.tobytes()
                    out += [(j["lead"], j["block"], j["portion"], j["asked"], cls, members) for j in jobs]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                names = sorted(held)
                links = link_cell([np.frombuffer(m, np.uint64) for _, m in names], percent, [held[x] for x in names] if asked else None)
                stars = [(names[a][0], names[b][0]) for a, b in star_links(len(names), links)]
                if stars:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars, strict=True)], names=["src", "dst"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lead", "block", "portion")), strict=True))
            cls, members, flags = (batch.column(c).to_pylist() for c in ("cls", "members", "asked"))
            for k, c, m, f in zip(keys, cls, members, flags, strict=True):
                if k != key:
                    yield from done()
                    key, held = k, {}
                held[c, m] = f or held.get((c, m), False)
        yield from done()

    sets = sources.join(for_doc.hint("shuffle_hash"), "cls").mapInArrow(expand, "lead long, block int, portion int, asked boolean, cls long, members binary")
    together = sets.repartition(n, "lead", "block", "portion").sortWithinPartitions("lead", "block", "portion")
    return together.mapInArrow(search, "src long, dst long")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell_cap: int = 512, pivots: int = 16, sample_docs: int = 8000, most_late: int = 200_000, rounds: int = 2, wide: int = 16
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) of each document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    late = _frequent(source, size, sample_docs, 8, most_late)
    made = cut(_sets(source, size, percent, docs.sparkSession.sparkContext.broadcast(late)))
    classes = cut(made.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("cls")))
    firsts = cut(made.join(classes.hint("shuffle_hash"), ["k1", "k2", "n"]).filter("doc_id = cls").select("cls", "k1", "k2", "n", "prefix", "bits"))
    sets = made.filter("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2")
    several = cut(sets.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("n", "k1", "k2") for f in (F.min, F.max))).filter("n_min < n_max or k1_min < k1_max or k2_min < k2_max").select("doc_id"))
    known = None
    if not several.isEmpty():  # rows that share a doc_id are one node
        own = sets.join(several, "doc_id", "left_semi").distinct().join(classes, ["k1", "k2", "n"])
        known = own.filter("cls <> doc_id").select(F.col("cls").alias("src"), F.col("doc_id").alias("dst"))
    links = _links(source, firsts, late, known, rounds, size, percent, cell_cap, pivots, most_late, wide)
    drop(firsts, several)
    parts = connected_components(links, small=0)
    named = classes.join(parts, classes["cls"] == parts["node"], "left").select("k1", "k2", "n", F.coalesce("component", "cls").alias("component"))
    out = made.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_sql(size: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for jaccard_components' rows over documents, by counting common shingles of all pairs that have one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
 s AS (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {size - 1}, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i+{size - 1}], ' '))) AS s FROM w),
 e AS (SELECT r, doc_id, len(s) AS n, hash(x) AS x FROM (SELECT r, doc_id, s, unnest(s) AS x FROM s) y),
 link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link), reach(node, seen) AS (SELECT x, x FROM edge UNION SELECT node, y FROM reach JOIN edge ON seen = x),
 label AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
 SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id FROM s LEFT JOIN label ON node = doc_id"""

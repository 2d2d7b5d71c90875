"""Operator 3: removal of long repeated byte strings by threshold-bounded interval expansion on a BWT.

A byte goes if a string of `length` bytes that covers it also starts somewhere else, in any document. Exact; strings
are judged on the input. Steps:

1. Whole copies of a text are one class; a text with copies loses everything (if it has `length` bytes at all), and one
   representative stands for it below. Very long texts are handled in slices whose windows don't overlap.
2. Anchors. Each window of `length` bytes names the smallest (by hash, leftmost) of its `gram`-byte grams. Equal windows
   name equal grams at equal offsets, so only windows of anchors that occur twice can repeat. One in seventy positions
   or so is an anchor; counting them needs no bytes of text.
3. Cells. The smallest text that has an anchor leads it; the anchors that stand first in one stretch of STRETCH bytes of
   their leader are a cell. Every text sends its bytes around the anchors of a cell there. Hot cells are dealt to blocks
   by text and slice; each block also gets the leader's stretch, which is bounded. So work is linear in what is sent,
   also for a text that repeats itself.
4. A block's stretches are joined, each with an end mark of its own; their suffix array, sorted by the first `length`
   bytes or more, gives the Burrows-Wheeler transform. Starting with the empty string's interval, each round extends every open interval backwards by each byte
   that precedes it (LF mapping) and so derives the common-prefix lengths of neighbouring suffixes by increasing value:
   an interval's right border gets the round's length if it had none, and only then stays open. After `length` rounds
   the borders without a value are those whose neighbours share `length` bytes or more: repeated windows.
5. Hot cells only: windows unique in their block, of which a gram of nine tenths of their length is somewhere else in
   the cell too, are compared with those of the cell's other blocks by their 128-bit hash, counted with map-side
   combining. No group is gathered.
6. Windows become spans of bytes; each document drops the union of its spans.

Defined results: null is the empty text; texts under `length` bytes lose nothing; rows that repeat a doc_id and text
are copies of each other; rows without doc_id are ignored; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.common import release, texts
from rodada.operators.work import cut, drop

LENGTH, GRAM = 200, 64
SLICE, STRETCH = 1 << 18, 1 << 16
PIECE = 2048
BLOCK_BYTES = 1 << 20
#: Copies of a leader's piece that one task writes, at most.
FAN = 256


def _byte_table() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), "<u8").astype(np.uint64)


_TABLE = _byte_table()
_FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size`-byte gram, by joining hashes of halves; size is written as a sum of powers of two."""
    with np.errstate(over="ignore"):
        h, n, done, out = _TABLE[data], 1, 0, None
        while True:
            if size & n:
                if out is None:
                    out = h[: len(data) - size + 1] if size == n else h.copy()
                else:
                    out = out[: len(data) - done - n + 1] * np.uint64(0xD6E8FEB86659FD93) + h[done : len(data) - n + 1]
                done += n
            if done == size:
                break
            h = h[:-n] * _FACTORS[n.bit_length()] + h[n:]
            h ^= h >> np.uint64(31)
            n *= 2
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def named_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the gram that each window of `length` bytes names, all grams' hashes). data has under 2^24 bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key & low).astype(np.int64), h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that some window names."""
    at, h = named_grams(data, length, gram)
    at = np.unique(at)
    return at, h[at]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols or more, then by place, by prefix doubling.

    The symbols are small; end marks in them are distinct.
    """
    n = len(symbols)
    bits = max(int(n - 1).bit_length(), int(symbols.max() + 1).bit_length(), 1)
    rank, step, place = symbols.astype(np.uint64), 1, np.arange(n, dtype=np.uint64)
    b, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    while True:
        second = np.zeros(n, np.uint64)
        if step < n:
            second[:-step] = rank[step:]
        key = (rank << b) | second
        if 3 * bits <= 64:  # the position rides along, which a plain sort allows
            both = np.sort((key << b) | place)
            order, key = (both & mask).astype(np.int64), both >> b
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        step *= 2
        if step >= min(depth, n):
            return order
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = fresh


def repeated_windows(pieces: list[np.ndarray], length: int, groups: bool = False):
    """For each piece of bytes, whether the window at each start (len - length + 1 of them) occurs elsewhere too.

    With groups also, for each window, a number that equal windows share.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum()) + m
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.empty(n, np.int32)
    text[ends] = np.arange(m)
    inside = np.ones(n, np.bool_)
    inside[ends] = False
    text[inside] = np.concatenate(pieces).astype(np.int32) + m
    sa = suffix_array(text, length + 1)
    at_row = np.empty(n, np.int32)
    at_row[sa] = np.arange(n, dtype=np.int32)
    lf = at_row[sa - 1]  # the row of the suffix that is longer by the byte before
    first = text[sa]
    before = text[sa - 1] >= m  # of the Burrows-Wheeler transform, only whether it is a byte is asked for from here on
    known = np.zeros(n + 1, np.bool_)  # borders that have their common-prefix length
    known[: m + 1] = known[n] = True
    owner = np.zeros(n, np.int32)
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo + 1
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        which = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        real = before[at]
        to = lf[at[real]]
        owner[to] = which[real]
        to.sort()
        if not len(to):
            break
        new = np.flatnonzero((to[1:] != to[:-1] + 1) | (owner[to[1:]] != owner[to[:-1]]) | (first[to[1:]] != first[to[:-1]])) + 1
        lo, hi = to[np.concatenate(([0], new))], to[np.concatenate((new - 1, [len(to) - 1]))]
        unset = ~known[hi + 1]
        lo, hi = lo[unset], hi[unset]
        known[hi + 1] = True
    whole = np.zeros(n, np.bool_)  # suffixes with `length` bytes before their end mark
    piece_of = np.repeat(np.arange(m), sizes + 1)
    whole[:] = ends[piece_of] - np.arange(n) >= length
    same = ~known[1:n] & whole[sa[1:]] & whole[sa[:-1]]
    twice = np.zeros(n, np.bool_)
    twice[sa[1:][same]] = True
    twice[sa[:-1][same]] = True
    of_pieces = lambda x: [x[a : a + max(0, s - length + 1)] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]
    if not groups:
        return of_pieces(twice)
    number = np.empty(n, np.int32)
    number[sa] = np.concatenate(([0], np.cumsum(~same)))
    return of_pieces(twice), of_pieces(number)


def runs(flags: np.ndarray, offset: int = 0) -> list[tuple[int, int]]:
    """[start, end) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(a + offset, b + offset) for a, b in edge.reshape(-1, 2).tolist()]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(parts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    """Stretches (start, bytes) of one text, overlapping or not, as pieces whose windows don't overlap."""
    whole: list[tuple[int, bytearray]] = []
    for start, data in sorted(parts):
        end = whole[-1][0] + len(whole[-1][1]) if whole else -1
        if start <= end:
            whole[-1][1].extend(data[end - start :])
        else:
            whole.append((start, bytearray(data)))
    for start, data in whole:
        for p in range(0, max(1, len(data) - length + 1), PIECE):
            yield start + p, bytes(data[p : p + PIECE + length - 1])


_KEY = "doc_id long, th long"


def _anchor_rows(source: DataFrame, length: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for rows, strings in texts(batch, "text", 64):
                for k, s in enumerate(strings):
                    data = np.frombuffer((s or "").encode(), np.uint8)
                    for part, at in enumerate(range(0, max(1, len(data) - length + 1), SLICE)):
                        where, h = anchors(data[at : at + SLICE + length - 1], length, gram)
                        if len(where):
                            one = [rows.column("doc_id")[k].as_py(), rows.column("th")[k].as_py(), part]
                            yield pa.RecordBatch.from_arrays([pa.array([one[0]], pa.int64()), pa.array([one[1]], pa.int64()), pa.array([part], pa.int32()), pa.array([h.view(np.int64)], pa.list_(pa.int64())), pa.array([(where + at).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "th", "part", "h", "at"])

    return source.filter(F.octet_length("text") >= length).mapInArrow(emit, f"{_KEY}, part int, h array<long>, at array<int>")


def fanned(pieces: DataFrame, parts: int) -> DataFrame:
    """Leaders' pieces (block -1, n), which go to all n blocks of their cell, as a row for each block.

    In two steps, so that no task writes more than FAN copies of a row: stretches of FAN blocks are dealt to tasks first.
    """
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / FAN).cast("int"))).alias("chunk")
    spread = pieces.select("*", chunk).repartition(parts, "cell", "chunk")
    block = F.explode(F.sequence(F.col("chunk") * FAN, (F.least((F.col("chunk") + 1) * FAN, "n") - 1).cast("int")))
    return spread.withColumn("block", block).drop("chunk")


def _search(source: DataFrame, wanted: DataFrame, wide: DataFrame | None, length: int, gram: int) -> DataFrame:
    """Per block: (doc_id, th, starts array<struct<a,b>>) of repeated windows; and for hot cells rows of window hashes.

    wide has the jobs of leaders whose cells have more than FAN blocks; wanted has all others.
    """
    reach, long_gram = length - gram, max(1, length - length // 10)
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("hot", pa.bool_()), ("pivot", pa.bool_()), ("bytes", pa.binary())])
        for batch in batches:
            for rows, strings in texts(batch, "text", 64):
                out = []
                for s, doc_id, th, jobs in zip(strings, *(rows.column(c).to_pylist() for c in ("doc_id", "th", "jobs")), strict=True):
                    data = s.encode()
                    for j in jobs:
                        end = min(len(data), (j["part"] + 1) * SLICE + length - 1)
                        for a, b in union([(max(j["part"] * SLICE, x - reach), min(end, x + length)) for x in j["at"]]):
                            for p in range(a, max(a + 1, b - length + 1), PIECE):
                                piece = data[p : min(b, p + PIECE + length - 1)]
                                out.append((j["cell"], j["block"], j["n"], doc_id, th, p, j["n"] > 1, j["pivot"], piece))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("cell", pa.int64()), ("starts", span), ("open", pa.list_(pa.struct([("w", pa.binary()), ("at", pa.int32()), ("g", pa.int64())])))])
        held: list[tuple] = []
        size, key = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            # cells that share a call, and a leader's stretch and other slices, may overlap: each byte must be there once
            by_doc: dict[tuple, list] = {}
            for x in held:
                by_doc.setdefault((x["doc_id"], x["th"]), []).append((x["start"], x["bytes"]))
            hot, cell = held[-1]["hot"], held[-1]["cell"]
            pieces = [(d, at, piece) for d, parts in by_doc.items() for at, piece in joined(parts, length)]
            arrays = [np.frombuffer(x, np.uint8) for _, _, x in pieces]
            flags, numbers = repeated_windows(arrays, length, True) if hot else (repeated_windows(arrays, length), None)
            starts: dict[tuple, list] = {}
            for (d, start, _), f in zip(pieces, flags, strict=True):
                starts.setdefault(d, []).extend({"a": a, "b": b} for a, b in runs(f, start))
            open_: dict[tuple, list] = {}
            if hot:  # the leader's stretch is in every block: what equals it is settled; of other equal windows one is told of
                pivots = union([(x["start"], x["start"] + len(x["bytes"]) - length + 1) for x in held if x["pivot"]])
                leader = next(((x["doc_id"], x["th"]) for x in held if x["pivot"]), None)
                everywhere = []
                for (d, start, _), f in zip(pieces, flags, strict=True):
                    there = np.zeros(len(f), np.bool_)
                    for a, b in pivots if d == leader else ():
                        there[max(0, a - start) : max(0, b - start)] = True
                    everywhere.append(there)
                settled = np.unique(np.concatenate([g[e] for g, e in zip(numbers, everywhere, strict=True)]))
                for (d, start, x), f, g, e in zip(pieces, flags, numbers, everywhere, strict=True):
                    new = np.flatnonzero(~f & ~e)
                    told, where = np.unique(g[f], return_index=True)
                    old = np.flatnonzero(f)[where[~np.isin(told, settled)]]
                    settled = np.union1d(settled, told)
                    at, h = named_grams(np.frombuffer(x, np.uint8), length, long_gram)
                    g = h.view(np.int64)[at] if len(at) else at
                    tell = lambda k, place: {"w": hashlib.blake2b(x[k : k + length], digest_size=16).digest(), "at": place, "g": int(g[k])}  # noqa: B023, E731
                    open_.setdefault(d, []).extend(tell(k, start + k) for k in new.tolist())
                    open_[d].extend(tell(k, -1) for k in old.tolist())
            rows = [(*d, cell, s, open_.get(d, [])) for d, s in starts.items() if s or open_.get(d)]
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for x in batch.to_pylist():
                if key != (x["cell"], x["block"]) and size > 0 and (size > (1 << 19) or x["hot"] or held[-1]["hot"]):
                    yield from done()
                    size = 0
                key = (x["cell"], x["block"])
                held.append(x)
                size += len(x["bytes"]) + 1
        yield from done()

    cut_out = lambda jobs: source.join(jobs.hint("shuffle_hash"), ["doc_id", "th"]).mapInArrow(stretches, f"cell long, block int, n int, {_KEY}, start int, hot boolean, pivot boolean, bytes binary")
    block = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array("block"))
    pieces = cut_out(wanted).withColumn("block", F.explode(block))
    if wide is not None:
        pieces = pieces.unionByName(fanned(cut_out(wide), n))
    together = pieces.drop("n").repartition(n, "cell", "block").sortWithinPartitions("cell", "block")
    return together.mapInArrow(search, f"{_KEY}, cell long, starts array<struct<a:int,b:int>>, open array<struct<w:binary,at:int,g:bigint>>")


def _cells(rows: DataFrame) -> DataFrame:
    """(doc_id, th, part, cell, pivot, at array) from anchors (h, doc_id, th, part, at) that occur twice or more.

    Anchors that make more than a fraction of all rows are joined by broadcast, which bounds them to a multiple of the
    number of partitions; the join of the others has no hot key.
    """
    first = F.min(F.struct("doc_id", "th", "at")).alias("f")
    leaders = cut(rows.groupBy("h").agg(first, F.count("*").alias("times")).filter("times > 1").select("h", "times", F.col("f.doc_id").alias("l_doc"), F.col("f.th").alias("l_th"), F.floor(F.col("f.at") / STRETCH).cast("int").alias("l_k")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = leaders.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") > max(100, total // (16 * parts))  # 16 * parts of them at most
    plain = leaders.drop("times")
    many, few = F.broadcast(leaders.filter(often).drop("times")), leaders.filter(~often).drop("times")
    cold = rows.join(F.broadcast(leaders.filter(often).select("h")), "h", "left_anti").join(few, "h").select("doc_id", "th", "part", "at", *plain.columns[1:])
    hot = rows.join(many, "h").select(*cold.columns)
    pivot = (F.col("doc_id") == F.col("l_doc")) & (F.col("th") == F.col("l_th")) & (F.floor(F.col("at") / STRETCH) == F.col("l_k"))
    found = cold.unionByName(hot).select("doc_id", "th", "part", "at", F.xxhash64("l_doc", "l_th", "l_k").alias("cell"), pivot.alias("pivot"))
    out = cut(found.groupBy("doc_id", "th", "part", "cell", "pivot").agg(F.collect_list("at").alias("at")))
    drop(leaders)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(source with doc_id, th, text; info with doc_id, th, copies, starts): starts are runs of repeated windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("doc_id is not null")
    keys = cut(source.select("doc_id", "th", F.sha2("text", 256).alias("sha")))
    classes = cut(keys.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("th").alias("th"), F.count("*").alias("copies")))
    reps = classes.select(F.col("rep").alias("doc_id"), "th")
    found = cut(_anchor_rows(source, length, gram))
    mine = cut(found.join(reps.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "part"]))
    drop(found)
    rows = mine.select("doc_id", "th", "part", F.explode(F.arrays_zip("h", "at")).alias("x")).select("doc_id", "th", "part", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    cells = _cells(rows)
    drop(mine)
    sizes = cells.groupBy("cell").agg(F.sum(F.size("at") * 90 + 2 * length).alias("bytes"))
    dealt = cells.join(sizes, "cell").withColumn("n", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    # a leader's stretch goes to all blocks of its cell (-1), any other one to its own
    block = F.when(F.col("pivot") & (F.col("n") > 1), -1).otherwise(F.pmod(F.xxhash64("doc_id", "th", "part"), F.col("n"))).cast("int")
    dealt = dealt.withColumn("block", block)
    of = lambda rows: rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("cell", "part", "n", "pivot", "block", "at")).alias("jobs"))
    fans = (F.col("block") < 0) & (F.col("n") > FAN)
    wide = None if dealt.filter(fans).isEmpty() else of(dealt.filter(fans))
    wanted = of(dealt.filter(~fans))
    made = cut(_search(source, wanted, wide, length, gram))
    drop(cells)
    starts = made.select("doc_id", "th", F.explode("starts").alias("s"))
    # equal windows name equal long grams: a window of which that gram is nowhere else in the cell is alone
    grams = made.select("doc_id", "th", "cell", F.explode(F.array_distinct(F.transform("open", lambda x: x["g"]))).alias("g"))
    shared = grams.join(grams.groupBy("cell", "g").agg(F.count("*").alias("c")).filter("c > 1").select("cell", "g"), ["cell", "g"]).groupBy("doc_id", "th", "cell").agg(F.collect_set("g").alias("gs"))
    left = made.filter(F.size("open") > 0).join(shared, ["doc_id", "th", "cell"]).select("doc_id", "th", "cell", F.filter("open", lambda x: F.array_contains("gs", x["g"])).alias("open"))
    open_ = cut(left.select("doc_id", "th", "cell", F.explode("open").alias("o")).select("doc_id", "th", "cell", F.col("o.w").alias("w"), F.col("o.at").alias("at")))
    often = open_.groupBy("cell", "w").agg(F.count("*").alias("c")).filter("c > 1").select("cell", "w")
    late = open_.filter("at >= 0").join(often, ["cell", "w"]).select("doc_id", "th", F.struct("at", (F.col("at") + 1).alias("b")).alias("s"))
    marks = starts.select("doc_id", "th", "s.a", "s.b").unionByName(late.select("doc_id", "th", F.col("s.at").alias("a"), "s.b")).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    each = keys.dropDuplicates(["doc_id", "th"]).join(classes.select("sha", "copies"), "sha").select("doc_id", "th", "copies")
    info = cut(each.join(marks, ["doc_id", "th"], "left"))
    drop(made, open_, keys, classes)
    return source, info


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document.

    with_text adds kept: the remaining bytes as text, without the remains of characters that a cut went through; and th,
    the hash of the whole text, which with doc_id names a row.
    """
    source, info = repeated_spans(docs, length, gram, id_col, text_col)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "th"][: 7 if with_text else 5]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for rows, strings in texts(batch, "text", 64):
                out = []
                for s, doc_id, th, copies, starts in zip(strings, *(rows.column(c).to_pylist() for c in ("doc_id", "th", "copies", "starts")), strict=True):
                    data = s.encode()
                    if copies > 1:
                        spans = [(0, len(data))] if len(data) >= length else []
                    else:
                        spans = union([(x["a"], x["b"] + length - 1) for x in starts or ()])
                    gone = sum(b - a for a, b in spans)
                    edges = [0, *(e for x in spans for e in x), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else data
                    out.append((doc_id, len(data), gone, len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), th)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, th long" if with_text else "")
    return source.join(info.hint("shuffle_hash"), ["doc_id", "th"]).mapInArrow(drop, schema)

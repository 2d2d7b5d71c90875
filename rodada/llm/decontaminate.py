"""Operator 10: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are an item's windows of `window` consecutive words (or all its words, if it has fewer). Patterns of one
length form one searcher: a shift table over blocks of two adjacent words says how far the search may jump, a bucket
table keyed by the pattern's last block holds the candidates, and a direct comparison confirms an occurrence. Words
rather than bytes are the search's symbols: texts are lower-cased (A-Z) and every separator byte becomes a space.

The patterns go to the workers in blocks of at most `max_windows` windows, a checked bound; with more, the documents
pass through the blocks one after the other, gathering hits, without a shuffle. Matches are exact.

Defined results: null or word-free texts have no words and no hits; items without words are ignored; items that share
a window all count; repeated item_ids count once; an item without item_id makes hits, but has no name to be counted by;
repeated rows and rows without doc_id give a row each; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.common import release, texts
from rodada.operators.work import cut

#: Separator bytes of the contract become spaces; bytes.lower() changes A-Z alone.
_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The text's words, lower-cased (A-Z)."""
    return text.encode().lower().translate(_WORDS).split() if text else []


class WuManber:
    """Searcher for word patterns of one length m; values are sets of item ids."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set], m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = b" ".join(p[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket.setdefault(b" ".join(p[m - self.block :]), []).append((list(p), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of each occurrence, ascending."""
        m, far, at, n = self.m, self.far, self.m, len(words)
        shift, bucket = self.shift.get, self.bucket
        while at <= n:
            key = words[at - 2] + b" " + words[at - 1] if m > 1 else words[at - 1]
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            for p, items in bucket[key]:
                if words[at - m : at] == p:
                    yield at - m, items
            at += 1


def patterns_of(items: list[tuple], window: int) -> dict[int, dict[tuple[bytes, ...], set]]:
    """length -> pattern -> item ids."""
    out: dict[int, dict] = {}
    for item_id, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            out.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item_id)
    return out


def hits(searchers: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words, and the items that occur."""
    spans, items = [], set()
    for s in searchers:
        for at, found in s.search(words):
            spans.append((at, at + s.m))
            items |= found
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged], items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_windows: int) -> Iterator[list[tuple]]:
    """Items, streamed to the driver in blocks of at most max_windows windows (or one item)."""
    block, held = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        n = max(1, len(words_of(r["t"])) - window + 1)
        if block and held + n > max_windows:
            yield block
            block, held = [], 0
        block.append((None if r["i"] is None else str(r["i"]), r["t"]))
        held += n
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, spans array<struct<a,b>> (word positions that are hit), items array<string>, and keep."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep if c not in ("doc_id", "text")))
    found = found.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<a:int,b:int>>)"), "items": F.expr("cast(array() as array<string>)")})
    blocks = _blocks(benchmark, item_col, item_text_col, window, max_windows)
    found = _search(found, docs.sparkSession.sparkContext.broadcast(next(blocks, [])), window)
    for block in blocks:
        found = _search(cut(found), docs.sparkSession.sparkContext.broadcast(block), window)
    return found.select(*dict.fromkeys(["doc_id", "n_words", "spans", "items", *keep]))


def _search(found: DataFrame, shared, window: int) -> DataFrame:
    """Add one pattern block's hits to each document's spans and items."""
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        searchers = [WuManber(p, m) for m, p in sorted(patterns_of(shared.value, window).items())]
        for batch in batches:
            for rows, strings in texts(batch, "text"):
                n, spans, items = [], rows.column("spans").to_pylist(), rows.column("items").to_pylist()
                for k, s in enumerate(strings):
                    w = words_of(s)
                    a, b = hits(searchers, w)
                    n.append(len(w))
                    if a:
                        spans[k] = spans[k] + [{"a": x, "b": y} for x, y in a]
                        items[k] = sorted(b.union(items[k]) - {None})
                new = {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, span), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in rows.schema.names], names=rows.schema.names)

    return found.mapInArrow(search, found.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = benchmark_hits(docs, benchmark, window, **options)
    # spans of several pattern blocks may overlap: count the words of their union
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"].cast("long"),
    )
    n_hit = F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(union)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def contamination_sql(window: int = 10) -> str:
    """DuckDB SQL for contamination's rows over documents and benchmark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"coalesce(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
 p AS (SELECT DISTINCT item, m, array_to_string(w[i:i+m-1], ' ') AS t FROM (SELECT item, w, least(len(w), {window}) AS m, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0) x),
 v AS (SELECT r, m, i, array_to_string(w[i:i+m-1], ' ') AS t FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) q WHERE len(w) >= m) x),
 h AS (SELECT r, v.m, i, item FROM v JOIN p ON p.m = v.m AND p.t = v.t), k AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + m)) AS j FROM h) x GROUP BY r),
 n AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) x GROUP BY r)
 SELECT doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(k.n, 0) > 0 AS contaminated FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)"""


def sha_of(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

"""Operator 12 [native]: shards of near equal bytes by histogram sort.

Documents are ordered by (56 bits of the text's MD5, doc_id, place of the row), so copies of a text are neighbours. A
narrow table of keys and sizes is written once. Splitters are then sought by counting: probes are the multiples of 2^s
of a key column, and a round counts the exact bytes between the probes of the open intervals. A splitter is settled by
the probe nearest to its share of all bytes, if that is within `tolerance` of a shard's share. Otherwise the stretch
between the two probes around its share is its interval of the next round, with a smaller s. Where that stretch holds
one value, a single text's copies, the next key column divides it; so a group of copies is only cut by a boundary that
would else miss its tolerance. A stretch of one row can't be divided and settles too. Rows are exchanged once.

Only counts come to the driver: a round has 256 probes a splitter at most.

Defined results: a null text has no bytes and is placed like the empty text; rows without doc_id come before the others
among the copies of their text; repeated rows are rows of their own, ordered by their place in the written table; an
empty table has no rows; a document larger than a shard's share makes its shard larger than the others; columns named
in keep are carried, those that clash with the result's own as <name>_in; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodada.operators.work import cut

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
KEYS = ("_h", "_id", "_row")
LEAST, MOST = -(2**63), 2**63 - 1
#: Rows find the splitters of their text's key by this many of its 56 bits.
_FOUND_BY = 12


def text_key(text: Column) -> Column:
    """The first 56 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 14), 16, 10).cast("long")


def sized(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, the key columns, and keep."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    taken = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *KEYS)
    carried = [F.col(c).alias(f"{c}_in" if c in taken else c) for c in keep if c != id_col]
    return docs.select(*own, *carried, text_key(text).alias("_h"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("_id")).withColumn("_row", F.monotonically_increasing_id())


def next_shift(low: int, high: int) -> int:
    """The largest multiple of 8 by which shifted low and high still differ, so that a round divides what is between."""
    return 56 if low < 0 <= high else 8 * (((low ^ high).bit_length() - 1) // 8)


def above(key: tuple) -> tuple:
    """A boundary whose last value may be past the largest long: then what is above the value before it."""
    while key and key[-1] > MOST:
        key = (*key[:-2], key[-2] + 1) if len(key) > 1 else ()
    return key


def splitters(table: DataFrame, shards: int, tolerance: float) -> list[tuple]:
    """The shards - 1 least keys, ascending, of all shards but the first; each is a prefix of the key columns' values."""
    ends = lambda c: (F.min(c).alias("low"), F.max(c).alias("high"))
    all_ = table.agg(F.sum("size").alias("n"), *ends("_h")).first()
    if all_["n"] is None:
        return []
    total, settled = all_["n"], {}
    start = (0, next_shift(all_["low"], all_["high"]) if all_["low"] < all_["high"] else 0, (), None)
    #: an open interval (key column, shift of its probes, values of the columns before, (shift, probe) that it lies in) -> its splitters and the bytes below it
    open_: dict[tuple, tuple[list[int], int]] = {start: (list(range(1, shards)), 0)}
    while open_:
        column, shift = min(open_, key=lambda x: (x[0], -x[1]))[:2]
        here = {x: open_.pop(x) for x in list(open_) if x[:2] == (column, shift)}
        for x, found in _counts(table, column, shift, list(here)).items():
            places, below = here[x]
            at = below
            for r in found:
                inside = [j for j in places if at * shards <= j * total < (at + r["n"]) * shards]
                rest = []
                for j in inside:
                    down, up = j * total - at * shards, (at + r["n"]) * shards - j * total
                    if min(down, up) <= tolerance * total or r["rows"] == 1:
                        settled[j] = above((*x[2], (r["probe"] + (down > up)) << shift))
                    else:
                        rest.append(j)
                if rest and r["low"] < r["high"]:
                    open_[(column, next_shift(r["low"], r["high"]), x[2], (shift, r["probe"]))] = (rest, at)
                elif rest:
                    open_[(column + 1, next_shift(r["next_low"], r["next_high"]), (*x[2], r["low"]), None)] = (rest, at)
                at += r["n"]
    return [settled[j] for j in range(1, shards)]


def _counts(table: DataFrame, column: int, shift: int, intervals: list[tuple]) -> dict[tuple, list[dict]]:
    """interval -> its probes that have rows, ascending: bytes and rows up to the next probe, least and largest value."""
    rows, key = table, KEYS[column]
    for k in range(column):
        rows = rows.filter(F.col(KEYS[k]).isin(sorted({x[2][k] for x in intervals})))
    inside = {x[3] for x in intervals}
    if None not in inside:
        condition = F.lit(False)
        for s in {s for s, _ in inside}:
            condition = condition | F.shiftright(key, s).isin(sorted(p for t, p in inside if t == s))
        rows = rows.filter(condition)
    next_key = KEYS[min(column + 1, len(KEYS) - 1)]
    grouped = rows.groupBy(*KEYS[:column], F.shiftright(key, shift).alias("probe")).agg(
        F.sum("size").alias("n"), F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"), F.min(next_key).alias("next_low"), F.max(next_key).alias("next_high")
    )
    found: dict[tuple, list[dict]] = {x: [] for x in intervals}
    by_place = {(x[2], x[3]): x for x in intervals}
    shifts = {s[0] if s else None for s in inside}
    for r in grouped.collect():
        prefix = tuple(r[k] for k in KEYS[:column])
        for s in shifts:
            x = by_place.get((prefix, None if s is None else (s, r["probe"] >> (s - shift))))
            if x:
                found[x].append(r.asDict())
    return {x: sorted(rs, key=lambda r: r["probe"]) for x, rs in found.items()}


def shard_of(table: DataFrame, keys: list[tuple]) -> DataFrame:
    """table with shard: how many of the splitters are at or below the row's key."""
    whole = sorted((*k, *[LEAST] * (len(KEYS) - len(k))) if k else (MOST,) * len(KEYS) for k in keys)
    bits = 56 - _FOUND_BY
    rows = []
    for top in range(1 << _FOUND_BY):
        a, b = (bisect_left(whole, (x << bits, LEAST, LEAST)) for x in (top, top + 1))
        rows.append((top, a, whole[a:b]))
    near = table.sparkSession.createDataFrame(rows, "_top long, _base int, _near array<struct<_h:long,_id:long,_row:long>>")
    key = F.struct(*KEYS)
    placed = table.withColumn("_top", F.shiftright("_h", bits)).join(F.broadcast(near), "_top")
    return placed.withColumn("shard", F.col("_base") + F.size(F.filter("_near", lambda s: s <= key))).drop("_top", "_base", "_near")


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null: the law has none), and keep."""
    table = cut(sized(docs, keep, id_col, text_col))
    placed = shard_of(table, splitters(table.select("size", *KEYS), shards, tolerance))
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(*KEYS)).cast("long") - 1
    out = placed.withColumns({"law": F.lit("bytes"), "slot": slot, "grown_shard": F.lit(None).cast("int")})
    own = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return out.select(*own, *(c for c in table.columns if c not in own and c not in KEYS))


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """All columns of docs as Parquet, a folder a shard, rows in the order of their slots."""
    placed = shard_documents(docs, shards, keep=tuple(docs.columns), **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shards_sql(shards: int = 40, percent: int = 1) -> str:
    """DuckDB SQL for the rows over documents (with a doc_id each), tolerance percent / 100."""
    return f"""WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text,'')) + {ROW_BYTES} AS BIGINT) AS size, coalesce(text,'') AS text, CAST('0x' || substr(md5(coalesce(text,'')), 1, 14) AS BIGINT) AS h, CAST(doc_id AS BIGINT) AS id FROM documents),
 t AS (SELECT CAST(sum(size) AS HUGEINT) AS total FROM d), j AS (SELECT CAST(j AS HUGEINT) AS j, total FROM t, (SELECT unnest(range(1, {shards})) AS j) x),
 b AS (SELECT l, CASE WHEN l < 7 THEN h >> (48 - 8*l) ELSE h END AS p, CASE WHEN l < 7 THEN 0 ELSE id >> (56 - 8*(l-7)) END AS q, CAST(sum(size) AS HUGEINT) AS n, count(*) AS c FROM d, (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS l) x GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(n) OVER (PARTITION BY l ORDER BY p, q) - n AS low FROM b), f AS (SELECT j, l, p, q, c, j*total - low*{shards} AS down, (low+n)*{shards} - j*total AS up, total FROM c JOIN j ON low*{shards} <= j*total AND j*total < (low+n)*{shards}),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY l) AS first FROM f WHERE least(down, up) * 100 <= {percent} * total OR c = 1) x WHERE first = 1),
 k AS (SELECT j, CASE WHEN l < 7 THEN (p + CASE WHEN down > up THEN 1 ELSE 0 END) << (48 - 8*l) ELSE p END AS h, CASE WHEN l < 7 THEN CAST(-9223372036854775808 AS BIGINT) ELSE (q + CASE WHEN down > up THEN 1 ELSE 0 END) << (56 - 8*(l-7)) END AS id FROM s),
 crc AS (SELECT list(list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(b AS BIGINT)) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b) x),
 r AS (SELECT d.doc_id, d.size, d.text, d.h, d.id, CAST((SELECT count(*) FROM k WHERE k.h < d.h OR k.h = d.h AND k.id <= d.id) AS INTEGER) AS shard FROM d)
 SELECT doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM r CROSS JOIN crc"""

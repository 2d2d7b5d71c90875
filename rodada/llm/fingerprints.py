"""Operator 6 [native]: document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is a line, cut further at sentence ends. Each one is hashed to a wide vector of 128 lanes of 0 or 1, and a
document's vector is the sum over its paragraphs; lane 128 counts them. Lanes are kept modulo 2^16 (the count modulo
2^32). Sums don't depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector
(`combine`). Equal multisets have equal fingerprints; different ones collide about as often as random 128-lane sums.

Likeness is a function of two fingerprints: 2 * lane - count, taken modulo 2^16 and read with its sign, is a sum of
random signs, so the lanes' dot product estimates how many paragraphs two documents share; it is divided by both norms
(cosine) and held in 0..1. Equal fingerprints have 1; empty against non-empty has 0.

Everything is DataFrame functions. Two lanes are summed in each 64-bit aggregate. The next document in ascending order
is found on range-partitioned keys, without a global window; texts are shuffled once, and of the next text only the
code points that are needed.

Defined results: null text is empty; one document is its own next one; rows that repeat (doc_id and text) give a row
each, and count once as a next document; documents of one doc_id are ordered by the hash of their text; rows without
doc_id have no place in the order and are left out; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rodada.operators.work import cut

LANES = 128
_SEEDS = (11, 12)
_PAIR = (1 << 32) | 1
_LOW = (1 << 32) - 1
#: Ends of paragraphs: line ends, and blanks after a sentence end.
PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"


def paragraph_sums(unit: Column) -> list[Column]:
    """Aggregates over a document's paragraphs: 64 sums of two lanes each, then the count."""
    there = (F.trim(unit) != "").cast("long")
    sums = []
    for seed in _SEEDS:
        h = F.xxhash64(F.lit(seed), unit)
        sums += [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_PAIR)) * there) for j in range(32)]
    return [*sums, F.sum(there)]


def lanes_of(packed: Column) -> Column:
    """The array of lanes, modulo 2^16, from the array of two-lane sums."""
    return F.flatten(F.transform(packed, lambda s: F.array(s.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(s, 32).bitwiseAND(F.lit(0xFFFF)))))


def fingerprint_text(lanes: Column, count: Column) -> Column:
    """The fingerprint as text: four hex digits a lane, eight for the count."""
    return F.concat(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFF))), 4, "0")), ""), F.lpad(F.hex(count.bitwiseAND(F.lit(_LOW))), 8, "0"))


def parse(fingerprint: Column) -> Column:
    """Lanes and count of a fingerprint text, as an array of 129 longs."""
    lane = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.conv(F.substring(fingerprint, k * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.concat(lane, F.array(F.conv(F.substring(fingerprint, F.lit(4 * LANES + 1), F.lit(8)), 16, 10).cast("long")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union (sign 1) or difference (sign -1) of two multisets of paragraphs."""
    total = F.zip_with(parse(a), parse(b), lambda x, y: F.pmod(x + y * sign, F.lit(1 << 32)))
    return fingerprint_text(F.slice(total, 1, LANES), F.element_at(total, LANES + 1))


def likeness(a: Column, n: Column, b: Column, m: Column) -> Column:
    """0..1 from the lanes (modulo 2^16) and counts of two fingerprints."""

    def signed(lane: Column, count: Column) -> Column:
        return F.pmod(lane * 2 - count + 0x8000, F.lit(0x10000)) - 0x8000

    def dot(x: Column, nx: Column, y: Column, ny: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: signed(p, nx) * signed(q, ny)), F.lit(0).cast("double"), lambda s, v: s + v)

    size = F.sqrt(dot(a, n, a, n) * dot(b, m, b, m))
    return F.when((a == b) & (n == m), F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, n, b, m) / size))).otherwise(F.lit(0.0))


def _neighbours(keys: DataFrame) -> DataFrame:
    """keys (doc_id, th, n_chars) with copies and the next key in order; after the last comes the first."""
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = keys.groupBy("doc_id", "th", "n_chars").agg(F.count("*").alias("copies"))
    dealt = cut(once.repartitionByRange(n, "doc_id", "th").withColumn("pid", F.spark_partition_id()))
    me = F.struct("doc_id", "th")
    heads = sorted((r["pid"], r["head"]) for r in dealt.groupBy("pid").agg(F.min(me).alias("head")).collect())  # a row a partition
    after = [(p, heads[(k + 1) % len(heads)][1]) for k, (p, _) in enumerate(heads)]
    follow = spark.createDataFrame([(p, h["doc_id"], h["th"]) for p, h in after], "pid int, f_doc long, f_th long")
    lead = F.lead(me).over(Window.partitionBy("pid").orderBy("doc_id", "th"))
    found = dealt.withColumn("lead", lead).join(F.broadcast(follow), "pid")  # as many rows as partitions
    return found.select("doc_id", "th", "n_chars", "copies", F.coalesce("lead.doc_id", "f_doc").alias("next_doc"), F.coalesce("lead.th", "f_th").alias("next_th"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("doc_id is not null")
    size = F.char_length("text").cast("long").alias("n_chars")
    order = cut(_neighbours(whole.select("doc_id", "th", size)))
    need = F.col("n_chars").cast("long") - F.ceil(F.col("n_chars") / 2)  # floor(n / 2)
    wanted = order.select(F.col("next_doc").alias("doc_id"), F.col("next_th").alias("th"), F.col("doc_id").alias("to_doc"), F.col("th").alias("to_th"), need.alias("need"), "copies", F.col("next_doc").alias("to_next"), F.col("next_th").alias("to_next_th"))
    half = whole.join(wanted.hint("shuffle_hash"), ["doc_id", "th"]).select(F.col("to_doc").alias("doc_id"), F.col("to_th").alias("th"), F.expr("substring(text, 1, cast(need as int))").alias("tail"), "copies", F.col("to_next").alias("next_doc"), F.col("to_next_th").alias("next_th"))
    edited = F.concat(F.expr("substring(text, 1, cast(ceil(n_chars / 2) as int))"), F.col("tail"))
    names = ["doc_id", "th", "n_chars", "copies", "next_doc", "next_th"]
    # both joins read the same columns of whole, so that its exchange is made once
    both = whole.join(half, ["doc_id", "th"]).select(*names[:2], size, *names[3:], "text", "tail").select(*names, "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    names += ["edited_sha256"]
    forms = both.select(*names, F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("t")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("t")))).alias("v"))
    units = forms.select(*names, F.col("v.form").alias("form"), F.posexplode(F.split("v.t", PARAGRAPH_END)).alias("pos", "unit"))
    sums = paragraph_sums(F.col("unit"))
    made = units.groupBy(*names, "form").agg(*(s.alias(f"s{k}") for k, s in enumerate(sums)), F.sum((F.col("pos") == 0).cast("long")).alias("times"))
    # rows that repeat were summed together `times` times
    once = made.select(*names, "form", F.array(*(F.expr(f"s{k} div times") for k in range(len(sums) - 1))).alias("packed"), F.expr(f"s{len(sums) - 1} div times").alias("n"))
    form = lambda k: F.first(F.when(F.col("form") == k, F.struct("packed", "n")), ignorenulls=True)
    pair = cut(once.groupBy(*names).agg(form(0).alias("own"), form(1).alias("changed")))
    following = pair.select(F.col("doc_id").alias("next_doc"), F.col("th").alias("next_th"), F.col("own").alias("following"))
    joined = pair.join(following, ["next_doc", "next_th"])
    lanes = joined.select("doc_id", "n_chars", "edited_sha256", "copies", *(x for c in ("own", "changed", "following") for x in (lanes_of(F.col(f"{c}.packed")).alias(c), F.col(f"{c}.n").bitwiseAND(F.lit(_LOW)).alias(f"n_{c}"))))
    out = lanes.select(
        "doc_id", "n_chars", "edited_sha256", "copies",
        fingerprint_text(F.col("own"), F.col("n_own")).alias("fingerprint"),
        fingerprint_text(F.col("changed"), F.col("n_changed")).alias("edited_fingerprint"),
        F.round(likeness(F.col("own"), F.col("n_own"), F.col("changed"), F.col("n_changed")), 6).alias("near_edited"),
        F.round(likeness(F.col("own"), F.col("n_own"), F.col("following"), F.col("n_following")), 6).alias("near_next"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")

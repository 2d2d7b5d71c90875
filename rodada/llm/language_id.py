"""Operator 5: language identification by rank-order n-gram profiles.

A profile lists a language's most frequent letter n-grams (orders 1 to n_max, inside blank-padded words) by rank. A
document's own list is compared to each profile by out-of-place distance: for each of its n-grams the difference of
ranks, or the profile's length if it isn't there. The nearest language wins; ties go to the smaller name.

Profiles are learnt from at most `train_docs` labelled documents of each language (a documented bound, chosen by
hash; all of them where there are fewer), so what the driver gathers doesn't grow with the corpus: `top` n-grams of
each language, for MAX_LANGUAGES languages at most. Prediction reads the whole text and nothing else, one document at a
time, without a shuffle.

Defined results: null text, or text without a letter, gives `und` with score 0; with no labelled documents every
document gets `und`; a null lang isn't learnt from; repeated rows give a row each; other columns are ignored.
score is 1 - distance / greatest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rodada.llm.common import release, texts

#: More than there are languages with a code; what is broadcast is bounded by top * 24 bytes for each.
MAX_LANGUAGES = 10_000


@cache
def _letter_table() -> np.ndarray:
    """Per code point: whether it is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def grams(text: str, n_max: int = 3) -> np.ndarray:
    """Codes of all n-grams of the text's blank-padded words: 21 bits a code point."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letter_table()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    code[~letter] = 32
    code = np.concatenate(([32], code, [32]))
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # of a run of blanks the first stays
    keep[0] = True
    code = code[keep]
    if code[0] == 32 and len(code) > 1 and code[1] == 32:
        code = code[1:]
    blank = code == 32
    out, packed, inner = [code[~blank]], code, np.zeros(len(code), np.bool_)
    for n in range(2, n_max + 1):
        packed = (packed[:-1] << 21) | code[n - 1 :]
        inner = inner[:-1] | (blank[n - 2 : -1] if n > 2 else np.zeros(len(packed), np.bool_))
        out.append(packed[~inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent codes, the most frequent first, ties by code."""
    if not len(codes):
        return codes
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(starts, len(codes)))
    order = np.argsort(-counts, kind="stable")[:top]
    return codes[starts[order]]


class Profiles:
    """All languages' ranks in one table: for each n-gram the languages that have it, and its ranks there."""

    def __init__(self, by_language: dict[str, np.ndarray], top: int):
        self.names, self.top = sorted(by_language), top
        parts = [by_language[x] for x in self.names]
        codes = np.concatenate(parts or [np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.language = np.repeat(np.arange(len(parts)), [len(x) for x in parts])[order]
        self.rank = np.concatenate([np.arange(len(x)) for x in parts] or [np.zeros(0, np.int64)])[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(codes)))

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        mine = ranked(codes, self.top)
        if not len(mine) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        place = np.flatnonzero(self.codes[np.minimum(at, len(self.codes) - 1)] == mine) if len(self.codes) else at[:0]
        many = self.many[at[place]]
        ends = np.cumsum(many)
        hit = np.repeat(self.first[at[place]] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)
        nearer = np.abs(self.rank[hit] - np.repeat(place, many)) - self.top
        apart = self.top * len(mine) + np.bincount(self.language[hit], weights=nearer, minlength=len(self.names))
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.top * len(mine)))


def learn(docs: DataFrame, top: int = 300, n_max: int = 3, train_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from docs, all of which may be learnt from."""
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null")
    there = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(there) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    buckets = 1_000_000
    share = [(lang, int(buckets * min(1.0, train_docs / n)) + 1) for lang, n in there.items()]
    bounds = F.create_map(*[F.lit(x) for pair in share for x in pair]) if share else F.create_map()
    some = labelled.filter("text is not null").filter(F.pmod(F.xxhash64("id"), F.lit(buckets)) < bounds[F.col("lang")]) if share else labelled.limit(0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", "text")))
    sample = some.withColumn("place", place).filter(F.col("place") <= train_docs)  # rows that share an id come together

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for rows, strings in texts(batch, "text", 64):  # a slice's n-grams are held at once
                held: dict[str, list] = {}
                for s, lang in zip(strings, rows.column("lang").to_pylist(), strict=True):
                    held.setdefault(lang, []).append(grams(s, n_max))
                for lang, parts in held.items():
                    codes, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counted.withColumn("place", best).filter(F.col("place") <= top).select("lang", "code", "place").collect()
    out: dict[str, list] = {lang: [] for lang in there}
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["lang"]].append(r["code"])
    return Profiles({lang: np.array(codes, np.int64) for lang, codes in out.items()}, top)


def identify(docs: DataFrame, profiles: Profiles, n_max: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [docs.schema[c] for c in keep]
    source = docs.select(*dict.fromkeys([text_col, *keep]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        p = shared.value
        for batch in batches:
            for rows, strings in texts(batch, text_col):
                found = [p.predict(grams(s, n_max)) if s else ("und", 0.0) for s in strings]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(predict, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that are never learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def language_id(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: profiles from the labelled documents that aren't held out."""
    profiles = learn(docs.filter(~held_out(id_col)), id_col=id_col, **options)
    source = docs.select(F.col(id_col).alias("doc_id"), "text", held_out(id_col).alias("held_out"))
    return identify(source, profiles, options.get("n_max", 3), keep=("doc_id", "held_out"))

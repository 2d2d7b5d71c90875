"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes what its predecessor kept, read back from Parquet, and its decisions take effect: documents or bytes
that it rejects are gone for the stages after it. All but the last return the columns of documents.

Defined results: null texts have no language and go in the first stage; rows without doc_id go in the second; rows that
share a doc_id are one document to the second stage, and each of their different texts stays or goes with it; rows that
repeat doc_id and text are one row after it; extra columns are left out; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rodada.llm.bpe import round_trip
from rodada.llm.common import table
from rodada.llm.decontaminate import benchmark_hits
from rodada.llm.language_id import held_out, identify, learn
from rodada.llm.ngram_join import jaccard_components
from rodada.llm.queries import tokenizer_path
from rodada.llm.suffix_dedup import remove_repeats
from rodada.operators.work import cut, drop

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text this far from every language's profile (1 is on a profile, 0 shares no frequent n-gram) is no text.
LEAST_SCORE = 0.2


def text_hash() -> Column:
    """With doc_id, what names a row; operator 3 calls it th."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a recognisable language go."""
    docs = docs.select(*COLUMNS)
    found = identify(docs, learn(docs.filter(~held_out())), keep=COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of documents that links connect, the one with the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    kept = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id", text_hash()).orderBy(F.xxhash64("lang", "source", "n_chars")))
    return docs.join(kept.hint("shuffle_hash"), "doc_id").withColumn("_place", once).filter("_place = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: bytes of long repeated passages go (and what they leave of cut characters); so do emptied documents."""
    docs = docs.select(*COLUMNS).withColumn("_th", text_hash())
    changed = remove_repeats(docs, with_text=True).filter("n_removed > 0").select("doc_id", F.col("th").alias("_th"), F.col("kept").alias("_kept")).dropDuplicates(["doc_id", "_th"])
    joined = docs.join(changed, ["doc_id", "_th"], "left").withColumn("text", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.col("_kept")))
    return joined.filter(F.trim("text") != "").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a passage of a benchmark item go."""
    docs = docs.select(*COLUMNS).withColumn("_th", text_hash())
    found = benchmark_hits(docs.select("doc_id", "text", "_th"), table(spark, sf_dir, "benchmark"), keep=("_th",))
    leaked = found.filter(F.size("spans") > 0).select("doc_id", "_th")
    return docs.join(leaked, ["doc_id", "_th"], "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of what is left, and the digest of their decoding."""
    return round_trip(docs, tokenizer_path(), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: No SQL: language profiles, byte-level spans and BPE are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if k:
            drop(before)
    return docs

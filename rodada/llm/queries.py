"""The queries of this subpackage, each over its whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rodada.llm.bpe import round_trip
from rodada.llm.common import table
from rodada.llm.decontaminate import contamination, contamination_sql
from rodada.llm.fingerprints import document_fingerprints
from rodada.llm.hard_negatives import hard_negatives, negatives_sql
from rodada.llm.html_text import page_texts
from rodada.llm.language_id import language_id
from rodada.llm.licenses import license_scan, license_sql
from rodada.llm.ngram_join import jaccard_components, jaccard_sql
from rodada.llm.sharding import shard_documents, shards_sql
from rodada.llm.suffix_dedup import remove_repeats
from rodada.llm.threshold_search import threshold_search, threshold_sql
from rodada.llm.token_counts import token_counts
from rodada.llm.token_store import token_store


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file, by name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=F.col("id") % 50 == 0, label=label, component=lambda x: F.floor(x.cast("double") * 256))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store, op2_license_scan, op3_suffix_dedup, op4_ngram_join, op5_language_id,
        op6_fingerprints, op7_token_counts, op8_html_text, op9_bpe_round_trip, op10_decontaminate,
        op11_hard_negatives, op12_sharding, op13_threshold_search,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_license_scan": license_sql(), "op4_ngram_join": jaccard_sql(), "op10_decontaminate": contamination_sql(), "op11_hard_negatives": negatives_sql(), "op12_sharding": shards_sql(), "op13_threshold_search": threshold_sql()}

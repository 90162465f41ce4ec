"""One registered query per operator, each over its whole table, and the SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.llm import (
    decontamination,
    language_id,
    ngram_join,
    packing,
    quality,
    secrets,
    suffix_repeats,
    suffix_tree_lm,
    target_resampling,
    token_counts,
    url_cascade,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scores(_table(spark, sf_dir, "documents"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"), size=4, percent=85).select(
        "doc_id", "n_shingles", "component_id"
    )


def op5_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op8_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(spark, _table(spark, sf_dir, "pages"))


def op11_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"))


for _query in (
    op1_suffix_tree_scores,
    op2_simhash_decontamination,
    op3_quality_ledger,
    op4_ngram_jaccard,
    op5_language_hierarchy,
    op6_secret_ownership,
    op7_suffix_repeats,
    op8_configuration_packing,
    op9_dictionary_warc,
    op10_url_cascade,
    op11_blockmatrix_whitening,
    op12_importance_resampling,
    op13_token_counts,
):
    QUERIES[_query.__name__] = _query

ORACLES["op3_quality_ledger"] = quality.SQL
ORACLES["op10_url_cascade"] = url_cascade.SQL
ORACLES["op4_ngram_jaccard"] = ngram_join.SQL
ORACLES["op7_suffix_repeats"] = suffix_repeats.SQL
ORACLES["op12_importance_resampling"] = target_resampling.SQL

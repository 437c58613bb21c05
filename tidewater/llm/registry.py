"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, langid, lattice, mixing, ngram_join, perplexity, quality_nbsvm, secret_scan, sharding, toxicity_fm

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_shard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(_table(spark, sf_dir, "documents"))


def op10_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_rules(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_nbsvm, op2_ngram_jaccard_join, op3_mix_sources, op4_lattice_near_dedup, op5_toxicity_fm,
        op6_bpe_round_trip, op7_secret_scan, op8_language_id, op9_shard_records, op10_perplexity_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": ngram_join.SQL,
    "op3_mix_sources": mixing.SQL,
    "op4_lattice_near_dedup": lattice.SQL,
    "op7_secret_scan": secret_scan.SQL,
}

"""A corpus from raw documents to token ids, in stages that each work on all their predecessor kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, langid, mixing, ngram_join, secret_scan
from tidewater.operators.lineage import stored

#: Rows in an Arrow batch: documents are long, and a batch lies in the executor and in its Python worker at once.
BATCH_ROWS = 500


def sized(stage):
    """A stage under the session's setting of BATCH_ROWS, unless the session was given one of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@sized
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; columns and values as they were.

    Null, empty and letterless texts are rejected; repeated rows share one fate; documents with a null
    language are judged too; an empty table gives no rows.
    """
    return langid.keep_identified(docs)


@sized
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of repeated rows one.

    Rows without an id and texts without words match nothing and stay; an empty table gives no rows.
    """
    return ngram_join.keep_one_of_each_group(docs)


@sized
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by the name of the rule, and n_chars follows.

    Null and empty texts stay as they are; repeated rows are each redacted.
    """
    return secret_scan.redact_secrets(docs)


@sized
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of their sources draw them.

    Null and empty texts are never drawn; a null language or source is a leaf of its own; repeated rows
    share one fate; an empty table gives no rows.
    """
    return mixing.mixed(docs)


@sized
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded_md5): token ids of every document drawn, and the digest of the text they decode to.

    A null text has null tokens and digest, an empty one no tokens; repeated rows are each encoded.
    """
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL can express neither the language models nor the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Readers and writers. Paths are those of any file system that Spark knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.qc import PAYLOAD, latest_by_id

ARTICLE = (
    "article_id string, url string, source string, title string, published_date date, crawled_date date, full_text string, char_length long, "
    "keyword_matched array<string>, source_keyword string, source_name string, commodities_mentioned array<string>"
)
CACHE = f"article_id string, extraction struct<{PAYLOAD.replace('reasoning_chain struct', 'reasoning_chain: struct').replace(', label string', ', label: string').replace('sentiment_score double', 'sentiment_score: double').replace('confidence double', 'confidence: double').replace('commodities array', 'commodities: array').replace('supply_location string', 'supply_location: string').replace('is_forward_looking boolean', 'is_forward_looking: boolean').replace('rationale string', 'rationale: string')}>, model string, tokens_prompt long, tokens_completion long, extracted_at timestamp, status string"
ANNOTATION = "article_id string, published_date string, title string, gpt_label string, gpt_sentiment_score double, source string, full_text string, human_label string, human_sentiment_score double, human_notes string"
TARGET = "period_id string, vf_inflation double"


def read_jsonl(spark: SparkSession, path: str, schema: str = ARTICLE, strict: bool = False, missing_ok: bool = False) -> DataFrame:
    """JSON lines. Strict raises on a bad line, otherwise it is dropped; with missing_ok no file is no rows."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last extraction of each article; bad lines and rows without an id are skipped."""
    rows = read_jsonl(spark, path, CACHE, missing_ok=True)
    return latest_by_id(rows.withColumn("pos", F.struct(F.coalesce("extracted_at", F.lit(0).cast("timestamp")), F.monotonically_increasing_id()))).drop("pos")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields without anything are NULL, those of two quotes are empty texts: the reader tells them apart only if NULL has a name, here one that no text has."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", f"null-{uuid.uuid4().hex}").csv(path)


def read_annotations(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(article_id, rater, label) of all raters' sheets."""
    parts = [read_csv(spark, p, ANNOTATION).select("article_id", F.lit(r).alias("rater"), F.col("human_label").alias("label")) for r, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, url, published."""
    items = spark.read.schema("title string, link string, pubDate string").option("rowTag", "item").xml(path)
    return items.select("title", F.col("link").alias("url"), F.col("pubDate").alias("published"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables of a row a period or a sampled article. White space at the ends of values stays."""
    writer = df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A table of few rows as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_annotation_sheet(sheet: DataFrame, guide: DataFrame, path: str) -> None:
    write_csv(sheet, f"{path}/sheet")
    write_csv(guide, f"{path}/guide")
    write_jsonl(sheet, f"{path}/sample")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Small tables as the sheets of one workbook on the driver; needs an Excel library that pandas knows."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)


def read_workbook(spark: SparkSession, path: str, schema: str, sheet: str = "Annotation") -> DataFrame:
    """A sheet of a workbook; needs an Excel library that pandas knows."""
    import pandas as pd

    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    frame = pd.read_excel(path, sheet_name=sheet)
    frame = frame.reindex(columns=names).astype(object).where(frame.reindex(columns=names).notna(), None)
    return spark.createDataFrame(list(frame.itertuples(index=False, name=None)), schema)


def append_to_cache(rows: DataFrame, path: str) -> None:
    """Appends instead of rewriting; readers take the last row of each article."""
    write_jsonl(rows, path, append=True)


def append_in_waves(parts: Iterable[DataFrame], path: str) -> int:
    """Appends part after part, so that a failure loses no more than one of them; how many there were."""
    n = 0
    for part in parts:
        append_to_cache(part, path)
        n += 1
    return n


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def annotation_guide(spark: SparkSession) -> DataFrame:
    """(label, criterion, explanation, score): what annotators see beside the sheet."""
    rows = [
        ("IRRELEVANT", "another region", "The event, the price or the broken road lies outside the province.", "0"),
        ("IRRELEVANT", "administered prices", "Subsidised sales, discounts and cheap markets are no market price.", "0"),
        ("IRRELEVANT", "speeches and plans", "Officials ask or promise; no goods move and no volumes are told.", "0"),
        ("IRRELEVANT", "named in passing", "The good is in a recipe, a restaurant, fodder or a private gift.", "0"),
        ("PRICEREPORT", "prices alone", "Prices rise, fall or rest, and no physical cause is told.", "-1 to 1"),
        ("PRICEREPORT", "official statistics", "A statistics office looks back on indices.", "-1 to 1"),
        ("PRICEREPORT", "stocks at rest", "Stocks are called safe and nothing large is added.", "-1 to 1"),
        ("SUPPLYSHOCK", "production or transport hit", "Failed harvests, pests, extreme weather, broken roads, illegal tolls.", "-1 to -0.3"),
        ("SUPPLYSHOCK", "a large harvest", "So much is reaped that buyers expect far more on the market.", "0.3 to 1"),
        ("SUPPLYSHOCK", "stocks released", "Thousands of tons are brought to market; what counts is the volume.", "-0.5 to 0.5"),
        ("DEMANDSHOCK", "buyers empty shelves", "Shown, not supposed: mass buying. A festive season alone is not enough.", "-0.8 to -0.3"),
        ("DEMANDSHOCK", "lasting new demand", "A large programme takes up goods that it did not take before.", "-0.8 to -0.3"),
        ("DEMANDSHOCK", "festive orders", "The text says that orders at producers rose for a feast.", "-0.6 to -0.3"),
        ("SUPPLYSHOCK", "tie-break", "A price report that tells a physical cause takes the label of the cause.", "as the label"),
    ]
    return spark.createDataFrame(rows, "label string, criterion string, explanation string, score string")

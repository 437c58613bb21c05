"""The article, extraction and period views of the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import COMMODITIES, LABELS, Config

#: Settings for orders as articles: their calendar, and a corpus that ends with them.
ORDERS = Config(anchor=dt.date(1995, 1, 1), date_end=dt.date(2001, 8, 1), analysis_start=dt.date(1999, 1, 1))
WORDS = Config(primary=("the and", "der die", "que los", "le la"), places=("the", "und", "el", "les"), forward=("the", "thing", "und", "que"), backward=("or", "ing", "er", "les"), commodities=("the", "and", "der", "que"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(dt.date(2021, 1, 1)), F.expr("cast(doc_id * 37 % 1885 as int)"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), F.col("doc_id").alias("pos"), F.col("text").alias("full_text"), F.col("n_chars").alias("char_length"), "source", "lang", F.substring("text", 1, 60).alias("title"), day.alias("published_date")
    )


ARTICLES = """articles AS (
  SELECT doc_id AS article_id, doc_id AS pos, text AS full_text, n_chars AS char_length, source, lang, substr(text, 1, 60) AS title,
    DATE '2021-01-01' + CAST(doc_id * 37 % 1885 AS INTEGER) AS published_date FROM documents)"""


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction of every document; `labelled` tells those that the table of labels has."""
    d, own = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    names = F.array(*[F.lit(x) for x in (*LABELS, "OTHER")])
    goods = F.array(*[F.lit(x) for x in COMMODITIES])
    pick = lambda e: F.element_at(goods, F.expr(f"cast(({e}) % 10 as int) + 1"))
    return d.join(own, "doc_id", "left").select(
        F.col("doc_id").alias("article_id"), F.element_at(names, F.expr("cast(doc_id % 5 as int) + 1")).alias("label"), F.expr("cast(doc_id * 7919 % 2201 - 1100 as double) / 1000d").alias("sentiment_score"),
        F.expr("case when doc_id % 31 <> 0 then cast(doc_id * 104729 % 1001 as double) / 1000d end").alias("confidence"), F.array(pick("doc_id"), F.concat(F.upper(pick("doc_id * 3 + 1")), F.lit(" "))).alias("commodities"),
        F.expr("case doc_id % 3 when 0 then '' when 1 then 'karo' end").alias("supply_location"), F.expr("case doc_id % 3 when 0 then true when 1 then false end").alias("is_forward_looking"),
        F.expr("n_chars div 4").alias("tokens_prompt"), F.expr("doc_id % 300").alias("tokens_completion"), F.expr("case when doc_id % 29 = 0 then 'failed' else 'success' end").alias("extraction_status"),
        F.coalesce("labelled", F.lit(False)).alias("labelled"),
    )


def extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions as they were appended (`nth`): an outdated one of each labelled document, and the one that counts."""
    now = extractions(spark, sf_dir).where("labelled").drop("labelled")
    old = now.withColumns({"label": F.lit("OTHER"), "sentiment_score": F.lit(0.5), "nth": F.lit(1)})
    return old.unionByName(now.withColumn("nth", F.lit(2)))


_GOODS = "[" + ", ".join(f"'{c}'" for c in COMMODITIES) + "]"
EXTRACTIONS = f"""extractions AS (
  SELECT d.doc_id AS article_id, [{", ".join(f"'{x}'" for x in (*LABELS, "OTHER"))}][CAST(d.doc_id % 5 AS INTEGER) + 1] AS label,
    CAST(d.doc_id * 7919 % 2201 - 1100 AS DOUBLE) / 1000 AS sentiment_score,
    CASE WHEN d.doc_id % 31 <> 0 THEN CAST(d.doc_id * 104729 % 1001 AS DOUBLE) / 1000 END AS confidence,
    [{_GOODS}[CAST(d.doc_id % 10 AS INTEGER) + 1], upper({_GOODS}[CAST((d.doc_id * 3 + 1) % 10 AS INTEGER) + 1]) || ' '] AS commodities,
    CASE d.doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'karo' END AS supply_location,
    CASE d.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_forward_looking,
    n_chars // 4 AS tokens_prompt, d.doc_id % 300 AS tokens_completion, CASE WHEN d.doc_id % 29 = 0 THEN 'failed' ELSE 'success' END AS extraction_status, l.doc_id IS NOT NULL AS labelled
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CLEAN = (
    EXTRACTIONS
    + """,
clean AS (
  SELECT * REPLACE (CASE WHEN confidence < 0.6 THEN 'IRRELEVANT' WHEN label IN ('SUPPLYSHOCK', 'DEMANDSHOCK', 'PRICEREPORT', 'IRRELEVANT') THEN label ELSE 'IRRELEVANT' END AS label,
    CASE WHEN sentiment_score IS NOT NULL THEN greatest(least(sentiment_score, 1.0), -1.0) END AS sentiment_score)
  FROM extractions WHERE extraction_status = 'success')"""
)

EXPLORED = (
    ARTICLES
    + ",\n"
    + EXTRACTIONS
    + """,
explored AS (SELECT a.*, CASE WHEN e.article_id IS NULL THEN 'NO_EXTRACTION' ELSE coalesce(e.label, 'UNKNOWN') END AS label, e.* EXCLUDE (article_id, label)
  FROM articles a LEFT JOIN (FROM extractions WHERE labelled) e ON a.article_id = e.article_id)"""
)


_COMMON = "abs(o_totalprice - 250000) < case when year(o_orderdate) < 1998 then 243000 when year(o_orderdate) < 2000 then 230000 else 0 end"


def period_obs(spark: SparkSession, sf_dir: str, sparse: bool = True) -> DataFrame:
    """All orders as labelled articles; sparse: of the early years only those of extreme prices are relevant."""
    orders = table(spark, sf_dir, "orders")
    common = _COMMON if sparse else "false"
    label = F.expr(f"case when {common} then 'IRRELEVANT' else case left(o_orderpriority, 1) when '1' then 'SUPPLYSHOCK' when '2' then 'DEMANDSHOCK' when '3' then 'PRICEREPORT' else 'IRRELEVANT' end end")
    return orders.select(
        F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").cast("date").alias("published_date"), label.alias("label"),
        F.expr("greatest(-1d, least(1d, (o_totalprice - 250000d) / 250000d))").alias("sentiment_score"), F.expr("0.5d + cast(o_orderkey % 51 as double) / 100d").alias("confidence"),
        F.when(label.isin("SUPPLYSHOCK", "DEMANDSHOCK"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("B")).otherwise("N/A").alias("type_ab"),
    )


def period_obs_sql(sparse: bool = True) -> str:
    common = _COMMON if sparse else "false"
    return f"""period_obs AS (
  SELECT article_id, published_date, label, sentiment_score, confidence,
    CASE WHEN label IN ('SUPPLYSHOCK', 'DEMANDSHOCK') THEN CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END ELSE 'N/A' END AS type_ab
  FROM (SELECT o_orderkey AS article_id, o_custkey, CAST(o_orderdate AS DATE) AS published_date,
    CASE WHEN {common} THEN 'IRRELEVANT' ELSE CASE left(o_orderpriority, 1) WHEN '1' THEN 'SUPPLYSHOCK' WHEN '2' THEN 'DEMANDSHOCK' WHEN '3' THEN 'PRICEREPORT' ELSE 'IRRELEVANT' END END AS label,
    greatest(-1.0, least(1.0, (o_totalprice - 250000) / 250000)) AS sentiment_score, 0.5 + CAST(o_orderkey % 51 AS DOUBLE) / 100 AS confidence
    FROM orders))"""


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period_num, y): the mean line price of each period from 1995 on."""
    from tidewater.functions.dates import period_number

    rows = table(spark, sf_dir, "lineitem").select(period_number(F.col("l_shipdate").cast("date"), ORDERS.anchor).alias("period_num"), "l_extendedprice")
    return rows.where("period_num is not null").groupBy("period_num").agg(F.avg("l_extendedprice").alias("y"))


TARGET = "target AS (SELECT CAST((CAST(l_shipdate AS DATE) - DATE '1995-01-01') // 14 + 1 AS INTEGER) AS period_num, avg(l_extendedprice) AS y FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1995-01-01' GROUP BY 1)"


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters who mostly agree with the label of the extraction."""
    names = F.array(*[F.lit(x) for x in LABELS])
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater"))
    at = F.expr("cast((article_id + case when (article_id * 31 + rater * 17) % 7 = 0 then rater else 0 end) % 4 as int) + 1")
    raw = F.when(F.expr("(article_id + rater) % 23 = 0"), F.lit(" ")).otherwise(F.concat(F.lower(F.element_at(names, at)), F.lit(" ")))
    return own.select("article_id", F.concat(F.lit("r"), F.col("rater").cast("string")).alias("rater"), raw.alias("label"))


RATERS = f"""raters AS (
  SELECT doc_id AS article_id, 'r' || r AS rater, CASE WHEN (doc_id + r) % 23 <> 0 THEN
    [{", ".join(f"'{x}'" for x in LABELS)}][CAST((doc_id + CASE WHEN (doc_id * 31 + r * 17) % 7 = 0 THEN r ELSE 0 END) % 4 AS INTEGER) + 1] END AS label
  FROM documents, (VALUES (1), (2), (3)) AS t(r))"""
PREDICTED = f"predicted AS (SELECT doc_id AS article_id, [{', '.join(f"'{x}'" for x in LABELS)}][CAST(doc_id % 4 AS INTEGER) + 1] AS label FROM documents)"
VOTES = """votes AS (SELECT article_id, label, count(label) AS n FROM raters GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS nxt FROM votes WINDOW w AS (PARTITION BY article_id ORDER BY n DESC, label NULLS FIRST)),
consensus AS (SELECT article_id, CASE WHEN n > 0 AND n > coalesce(nxt, 0) THEN label ELSE 'CONFLICT' END AS label FROM ranked WHERE place = 1)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in LABELS])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.element_at(names, F.expr("cast(doc_id % 4 as int) + 1")).alias("label"))

"""The 14-day feature table.

Articles are first summed by day, combined before the shuffle; whatever their number, what follows
handles a row a day. The decay of each subset is measured from that subset's own latest day in the
period and applied to the sums of its days. The spine, a row for each period, is small as well.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.functions import dates

INDICES = {
    "all": "label <> 'IRRELEVANT'",
    "supply": "label = 'SUPPLYSHOCK'",
    "demand": "label = 'DEMANDSHOCK'",
    "typeA": "type_ab = 'A'",
    "typeB": "type_ab = 'B'",
}
FEATURES = (
    "period_id date_start date_end is_historical coverage_flag low_confidence_period "
    + " ".join(f"sentiment_{k}" for k in INDICES)
    + " n_articles_total n_relevant n_supplyshock n_demandshock n_pricereport n_typeA max_neg_sentiment prop_negative_articles has_extreme_news no_relevant_news_t is_imputed"
).split()


def _day_sums(rules: dict[str, Column]) -> list[Column]:
    """For each rule: rows, weights and weighted scores of a day."""
    out = []
    for k, rule in rules.items():
        out += [
            F.count(F.when(rule, 1)).alias(f"_n_{k}"), F.sum(F.when(rule, F.col("confidence"))).alias(f"_w_{k}"),
            F.sum(F.when(rule & F.col("confidence").isNotNull(), F.col("confidence") * F.col("sentiment_score"))).alias(f"_s_{k}"),
        ]
    return out


def weighted_index(name: str, decay: float) -> Column:
    """Confidence-weighted score of days with exponential decay from the day `_latest_name`; 0 if no weight, NULL if no row."""
    fade = F.exp(-F.lit(decay) * F.datediff(F.col(f"_latest_{name}"), F.col("published_date")))
    total = F.sum(F.col(f"_w_{name}") * fade)
    return F.when(F.sum(f"_n_{name}") == 0, None).when(total == 0, 0.0).otherwise(F.sum(F.col(f"_s_{name}") * fade) / total)


def _latest(days: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Days with the latest day of each subset; the window holds the days of a group, not its articles."""
    whole = Window.partitionBy(*keys)
    return days.withColumns({f"_latest_{k}": F.max(F.when(F.col(f"_n_{k}") > 0, F.col("published_date"))).over(whole) for k in names})


def sentiment_index(articles: DataFrame, keys: list[str], decay: float) -> DataFrame:
    """The index of each group of articles(published_date, confidence, sentiment_score)."""
    days = articles.groupBy(*keys, "published_date").agg(*_day_sums({"all": F.lit(True)}))
    return _latest(days, ["all"], keys).groupBy(*keys).agg(F.coalesce(weighted_index("all", decay), F.lit(0.0)).alias("sentiment_index"))


def period_aggregates(articles: DataFrame, config: Config) -> DataFrame:
    """A row for each period that has articles; articles without a date or before the anchor are left out."""
    rules = {k: F.coalesce(F.expr(rule), F.lit(False)) for k, rule in INDICES.items()}
    relevant = rules["all"]
    count = lambda rule: F.count(F.when(F.expr(rule), 1))
    days = articles.where(F.col("published_date") >= F.lit(config.anchor)).groupBy("published_date").agg(
        *_day_sums(rules),
        F.count("*").alias("n_articles_total"),
        *[count(f"label = '{label}'").alias(f"n_{label.lower()}") for label in config.labels[:3]],
        F.min(F.when(relevant, F.col("sentiment_score"))).alias("max_neg_sentiment"),
        F.count(F.when(relevant & (F.col("sentiment_score") < -0.3), 1)).alias("_negative"),
        F.max(F.when(F.expr("label = 'SUPPLYSHOCK' and sentiment_score < -0.7"), 1).otherwise(0)).alias("has_extreme_news"),
    )
    days = days.withColumn("period_num", dates.period_number(F.col("published_date"), config.anchor)).where("period_num is not null")
    return _latest(days, list(INDICES), ["period_num"]).groupBy("period_num").agg(
        *[weighted_index(k, config.decay).alias(f"sentiment_{k}") for k in INDICES],
        *[F.sum(c).alias(c) for c in ("n_articles_total", *[f"n_{label.lower()}" for label in config.labels[:3]])],
        F.sum("_n_all").alias("n_relevant"),
        F.sum("_n_typeA").alias("n_typeA"),
        F.min("max_neg_sentiment").alias("max_neg_sentiment"),
        (F.sum("_negative") / F.nullif(F.sum("_n_all"), F.lit(0))).alias("prop_negative_articles"),
        F.max("has_extreme_news").alias("has_extreme_news"),
    )


def spine(spark: SparkSession, config: Config) -> DataFrame:
    """Every period from the anchor to the end: period_num, period_id, date_start, date_end, is_historical."""
    number = F.col("period_num")
    base = spark.range(1, dates.periods_until(config.anchor, config.date_end) + 1).select(F.col("id").cast("int").alias("period_num"))
    return base.select(
        "period_num", dates.period_id(number).alias("period_id"), dates.period_start(number, config.anchor).alias("date_start"), dates.period_end(number, config.anchor).alias("date_end"),
        (dates.period_start(number, config.anchor) < F.lit(config.analysis_start)).alias("is_historical"),
    )


def impute(features: DataFrame, columns: list[str], neutral: float = 0.0) -> DataFrame:
    """Low-confidence gaps become neutral; other gaps take the last value before them, else neutral.

    features has one row for each period, so the single ordered window is small.
    """
    so_far = Window.orderBy("period_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for c in columns:
        set_ = F.when(F.col("low_confidence_period"), F.coalesce(c, F.lit(neutral))).otherwise(F.col(c))
        out[c] = F.coalesce(F.when(F.col("low_confidence_period"), set_).otherwise(F.last(set_, ignorenulls=True).over(so_far)), F.lit(neutral))
    return features.withColumns(out)


def biweekly_features(articles: DataFrame, config: Config) -> DataFrame:
    """The dense feature table of articles(published_date, label, type_ab, sentiment_score, confidence)."""
    table = spine(articles.sparkSession, config).join(period_aggregates(articles, config), "period_num", "left")
    zero = [c for c in FEATURES if c.startswith("n_") or c in ("max_neg_sentiment", "prop_negative_articles", "has_extreme_news")]
    table = table.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    n = F.col("n_relevant")
    table = table.withColumns({
        "coverage_flag": F.when(n < config.sparse, "SPARSE").when(n >= config.dense, "DENSE").otherwise("NORMAL"),
        "low_confidence_period": n < config.min_relevant,
        "no_relevant_news_t": F.when(n == 0, 1).otherwise(0),
        "is_imputed": F.col("n_articles_total") == 0,
    })
    return impute(table, [f"sentiment_{k}" for k in INDICES], config.neutral).select(*FEATURES)


def coverage_totals(features: DataFrame) -> DataFrame:
    """Imputed, low-confidence and historical periods, their shares, and the periods of each flag."""
    flag = lambda name: F.count(F.when(F.col("coverage_flag") == name, 1)).alias(f"n_{name.lower()}")
    total = F.count("*")
    number = {c: F.count(F.when(F.col(c), 1)) for c in ("is_imputed", "low_confidence_period", "is_historical")}
    return features.agg(
        total.alias("n_periods"), *[n.alias(f"n_{c}") for c, n in number.items()], *[F.round(n * 100.0 / total, 6).alias(f"pct_{c}") for c, n in number.items()], *[flag(f) for f in ("SPARSE", "NORMAL", "DENSE")]
    )


def analytic(features: DataFrame) -> DataFrame:
    return features.where("not is_historical")


def with_settings(config: Config, **changes: dt.date | int | float) -> Config:
    from dataclasses import replace

    return replace(config, **changes)

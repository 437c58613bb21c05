"""A/B classification of shock articles, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.functions.typeab import rule_typeab

UNDECIDED = "rule_ambiguous_llm_disabled"


def classify(articles: DataFrame, config: Config, decisions: DataFrame | None = None) -> DataFrame:
    """articles with type_ab, ab_confidence, temporal_signal, ab_method.

    Rules decide first; what they leave open takes the model's decisions(article_id, type_ab,
    ab_confidence, temporal_signal) if there are any, and else counts as N/A by fallback.
    """
    whole = F.concat_ws(" ", F.coalesce("full_text", F.lit("")), F.coalesce("title", F.lit("")))
    shock = F.col("label").isin(*config.shock_labels)
    ruled = articles.withColumn("_r", F.when(shock, rule_typeab(whole, config.forward, config.backward)))
    if decisions is None:
        ruled = ruled.withColumn("_d", F.lit(None).cast("struct<type_ab: string, ab_confidence: double, temporal_signal: string>"))
    else:
        ruled = ruled.join(decisions.select("article_id", F.struct("type_ab", "ab_confidence", "temporal_signal").alias("_d")), "article_id", "left")
    rule, model = F.col("_r.type_ab").isNotNull(), F.col("_d.type_ab").isin("A", "B")
    shock = F.coalesce(shock, F.lit(False))
    return ruled.withColumns({
        "type_ab": F.when(~shock, "N/A").when(rule, F.col("_r.type_ab")).when(model, F.col("_d.type_ab")).otherwise("N/A"),
        "ab_confidence": F.when(shock & rule, F.col("_r.ab_confidence")).when(shock & model, F.col("_d.ab_confidence")).otherwise(0.0),
        "temporal_signal": F.when(~shock, "").when(rule, F.col("_r.temporal_signal")).when(model, F.col("_d.temporal_signal")).otherwise(UNDECIDED),
        "ab_method": F.when(~shock, "").when(rule, "rule").when(model, "llm").otherwise("fallback"),
    }).drop("_r", "_d")


def distribution(classified: DataFrame, config: Config) -> DataFrame:
    """(type_ab, ab_method, n, pct) of the shock articles."""
    shock = classified.where(F.col("label").isin(*config.shock_labels))
    per = shock.groupBy("type_ab", "ab_method").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("type_ab", "ab_method", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))  # one row


def guards(classified: DataFrame, config: Config) -> DataFrame:
    """Whether A has 20 to 50 % of what is classified, and N/A at most 5 % of all shocks."""
    shock = classified.where(F.col("label").isin(*config.shock_labels))
    n = lambda t: F.count(F.when(F.col("type_ab") == t, 1))
    pct_a = F.coalesce(n("A") * 100.0 / F.nullif(n("A") + n("B"), F.lit(0)), F.lit(0.0))
    pct_na = F.coalesce(n("N/A") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    table = shock.agg(F.round(pct_a, 6).alias("pct_a"), F.round(pct_na, 6).alias("pct_na"))
    verdict = F.when(F.col("pct_a") < 20, "few_a").when(F.col("pct_a") > 50, "many_a").otherwise("ok")
    return table.withColumns({"a_share": verdict, "too_many_open": F.col("pct_na") > 5})

"""The exported features and the checks before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.qc import clamp, pruned

EXPORTED = (
    ["period_id", "date_start", "date_end"] + [f"sentiment_{k}" for k in ("typeA", "supply", "demand", "all")] + [f"n_{k}" for k in "typeA relevant supplyshock demandshock".split()]
) + "has_extreme_news no_relevant_news_t low_confidence_period is_imputed".split()


def final_features(features: DataFrame) -> DataFrame:
    """The exported columns, in order of period, the main index within its range."""
    table = pruned(features, EXPORTED)
    if "sentiment_typeA" in table.columns:
        table = table.withColumn("sentiment_typeA", clamp(F.col("sentiment_typeA"), -1, 1))
    return table.orderBy("period_id") if "period_id" in table.columns else table


def checklist(features: DataFrame, granger_exists: bool = True, validation: bool | None = None, order: str | None = None) -> DataFrame:
    """(check_name, passed, value): a row for each check, and `all_passed` over those that can fail.

    validation: whether the report passed, None if there is none. `order` names the column with the rows'
    present order, and must then be there; without it the order of the frame counts, which is known only
    of rows that were read or sorted before.
    """
    columns = [c for c in EXPORTED if c in features.columns]
    table = features
    if order is None:
        table, order = table.withColumn("_order", F.monotonically_increasing_id()), "_order"
    table = table.withColumn("_before", F.lag("period_id").over(Window.orderBy(order)))  # a row a period
    missing = {f"no_missing_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in columns if c != "is_imputed"}
    out = {"sentiment_typeA_range": F.count(F.when(~F.col("sentiment_typeA").between(-1, 1), 1))} if "sentiment_typeA" in columns else {}
    unsorted = {"periods_sorted": F.count(F.when(F.col("_before") > F.col("period_id"), 1))}
    counts = table.agg(*[c.alias(k) for k, c in (missing | out | unsorted).items()], F.count("*").alias("row_count"))
    names = list(missing | out | unsorted)
    fixed = {"granger_results_exist": granger_exists, "validation_report_exist": validation is not None, "validation_passed": bool(validation)}
    rows = F.array(*[F.struct(F.lit(k).alias("check_name"), (F.col(k) == 0).alias("passed"), F.col(k).alias("value")) for k in names], *[F.struct(F.lit(k).alias("check_name"), F.lit(v).alias("passed"), F.lit(0).cast("long").alias("value")) for k, v in fixed.items()])
    whole = F.struct(F.lit("all_passed").alias("check_name"), F.forall(rows, lambda r: r.passed).alias("passed"), F.col("row_count").alias("value"))
    return counts.select(F.explode(F.concat(rows, F.array(whole))).alias("r")).select("r.*")

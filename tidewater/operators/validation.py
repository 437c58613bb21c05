"""Human validation: stratified sample, agreement, consensus, classification metrics.

Annotations come in long form, annotations(article_id, rater, label), so any number of raters costs
one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot(key: Column, seed: int) -> Column:
    """A seeded lot: hexadecimal digits, as good as random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified_sample(rows: DataFrame, n: int, floor: int, key: str = "article_id", seed: int = 42) -> DataFrame:
    """n rows: of each label at least min(floor, its rows), the rest in proportion to what is left.

    If the floors exceed n they shrink to n over the number of labels. Proportional quotas are rounded
    to the nearest even integer and topped up, or cut, by the order of a seeded lot, which also decides
    within labels and is the order of the result. If n is not below the number of rows, all.
    Only rows whose lot may be among the first n of their label are put in order.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row a label
    total, n_labels = sum(sizes.values()), len([k for k in sizes if k is not None])
    if not total or n >= total:
        return rows
    floor = n // n_labels if floor * n_labels > n else floor
    base = sum(min(floor, s) for s in sizes.values())
    left, pool = n - base, total - base
    quota = {k: min(floor, s) + (round((s - min(floor, s)) * left / pool) if pool else 0) for k, s in sizes.items()}
    spare = n + 6 * n**0.5 + 20
    plan = rows.sparkSession.createDataFrame([(k, q, min(1.0, spare / sizes[k])) for k, q in quota.items()], "_stratum string, _quota long, _reach double")
    drawn = rows.withColumn("_lot", lot(F.col(key), seed)).join(F.broadcast(plan), F.col("label").eqNullSafe(F.col("_stratum"))).drop("_stratum")
    share = F.conv(F.substring("_lot", 1, 13), 16, 10).cast("double") / float(1 << 52)
    near = drawn.where(share < F.col("_reach"))
    found = {r[0]: r[1] for r in near.groupBy("label").count().collect()}
    if any(found.get(k, 0) < min(n, s) for k, s in sizes.items()):  # so far out by chance that all rows are needed
        near = drawn
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("_lot", key)))
    first = (F.col("_rank") > floor).cast("int") + (F.col("_rank") > F.col("_quota")).cast("int")
    return ranked.withColumn("_turn", first).orderBy("_turn", "_lot", key).limit(n).orderBy("_lot", key).drop("_lot", "_rank", "_quota", "_reach", "_turn")


def tidy_labels(annotations: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Labels upper-cased and trimmed; blanks, NAN and unknown labels become NULL."""
    upper = F.upper(F.trim("label"))
    return annotations.withColumn("label", F.when(upper.isin(*labels), upper))


def majority(annotations: DataFrame) -> DataFrame:
    """(article_id, label): the most frequent label, CONFLICT without one or with a tie."""
    per = annotations.groupBy("article_id", "label").agg(F.count("label").alias("n"))
    order = Window.partitionBy("article_id").orderBy(F.desc("n"), "label")
    best = per.select("article_id", "label", "n", F.row_number().over(order).alias("place"), F.lead("n").over(order).alias("next"))
    clear = (F.col("n") > 0) & (F.col("n") > F.coalesce("next", F.lit(0)))
    return best.where("place = 1").select("article_id", F.when(clear, F.col("label")).otherwise("CONFLICT").alias("label"))


def confusion(truth: DataFrame, predicted: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(actual, predicted, n) over all pairs of labels; conflicts are left out."""
    spark = truth.sparkSession
    spine = spark.createDataFrame([(a, b) for a in labels for b in labels], "actual string, predicted string")
    both = truth.where("label <> 'CONFLICT'").select("article_id", F.col("label").alias("actual")).join(predicted.select("article_id", F.col("label").alias("predicted")), "article_id")
    n = both.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return spine.join(n, ["actual", "predicted"], "left").na.fill(0, ["n"])


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1, macro_f1); 0 where a denominator is 0."""
    hit = matrix.where("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("tp"))
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("found"))
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    each = hit.join(rows, "label").join(cols, "label").select("label", "support", part("tp", "found").alias("precision"), part("tp", "support").alias("recall"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    each = each.withColumn("f1", f1)
    macro = each.agg(F.avg("f1").alias("macro_f1"))
    r = lambda c: F.round(c, 6).alias(c)
    return each.crossJoin(F.broadcast(macro)).select("label", "support", r("precision"), r("recall"), r("f1"), r("macro_f1"))  # one row


def cohen_kappa(annotations: DataFrame) -> DataFrame:
    """(rater_a, rater_b, n, kappa) of every pair of raters over the articles both labelled."""
    a = annotations.where("label is not null").select("article_id", F.col("rater").alias("rater_a"), F.col("label").alias("x"))
    b = annotations.where("label is not null").select("article_id", F.col("rater").alias("rater_b"), F.col("label").alias("y"))
    joint = a.join(b, "article_id").where("rater_a < rater_b").groupBy("rater_a", "rater_b", "x", "y").agg(F.count("*").alias("n"))
    pair = Window.partitionBy("rater_a", "rater_b")
    total = F.sum("n").over(pair)
    shares = joint.withColumns({"total": total, "px": F.sum("n").over(Window.partitionBy("rater_a", "rater_b", "x")), "py": F.sum("n").over(Window.partitionBy("rater_a", "rater_b", "y"))})
    agree = shares.groupBy("rater_a", "rater_b").agg(F.max("total").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.max("total")).alias("po"))
    rows = shares.select("rater_a", "rater_b", "total", F.col("x").alias("label"), F.col("px")).distinct()
    cols = shares.select("rater_a", "rater_b", F.col("y").alias("label"), F.col("py")).distinct()
    chance = rows.join(cols, ["rater_a", "rater_b", "label"], "left").groupBy("rater_a", "rater_b").agg(F.sum(F.coalesce("py", F.lit(0)) * F.col("px") / (F.col("total") * F.col("total"))).alias("pe"))
    return agree.join(chance, ["rater_a", "rater_b"]).select("rater_a", "rater_b", "n", F.round((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)), 6).alias("kappa"))


def krippendorff_alpha(annotations: DataFrame) -> DataFrame:
    """(n_units, n_values, alpha), nominal; articles with fewer than two labels don't count."""
    n = annotations.where("label is not null").groupBy("article_id", "label").agg(F.count("*").alias("n"))
    n = n.withColumn("m", F.sum("n").over(Window.partitionBy("article_id"))).where("m > 1")
    observed = n.agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("d_o"), F.sum("n").alias("values"), F.count_distinct("article_id").alias("units"))
    squares = n.groupBy("label").agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    both = observed.crossJoin(F.broadcast(squares))  # one row each
    d_e = (F.col("values") * F.col("values") - F.col("squares")) / F.nullif(F.col("values") - 1, F.lit(0))
    return both.select(F.col("units").alias("n_units"), F.col("values").alias("n_values"), F.round(1 - F.col("d_o") / F.nullif(d_e, F.lit(0.0)), 6).alias("alpha"))


def annotation_sheet(sample: DataFrame, limit: int = 800) -> DataFrame:
    """What annotators get: model labels renamed, texts cut, three empty columns."""
    kept = [c for c in ("article_id", "published_date", "title") if c in sample.columns]
    return sample.select(
        *kept, F.col("label").alias("gpt_label"), F.col("sentiment_score").alias("gpt_sentiment_score"), "source", F.left("full_text", F.lit(limit)).alias("full_text"),
        F.lit(None).cast("string").alias("human_label"), F.lit(None).cast("double").alias("human_sentiment_score"), F.lit("").alias("human_notes"),
    )

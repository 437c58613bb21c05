"""Coverage and exploration reports. Every count names its tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import dates
from tidewater.functions.text import clean_word


def counts(rows: DataFrame, key: str | Column, name: str = "value") -> DataFrame:
    """(value, n, pct): rows of each value and their share."""
    counted = rows.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(name, "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))  # total is one row


def top(rows: DataFrame, key: str | Column, k: int, name: str = "value") -> DataFrame:
    """The k most frequent values; ties in the order of the value."""
    return counts(rows, key, name).orderBy(F.desc("n"), name).limit(k)


def exploded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element, lower-cased and trimmed."""
    return rows.withColumn(name, F.explode(column)).withColumn(name, F.lower(F.trim(name)))


def label_distribution(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(label, n, pct) of every valid label, also those of no row."""
    spine = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return spine.join(counts(rows, "label", "label"), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pct", F.lit(0.0)).alias("pct"))


BINS = 4096


def quantiles(rows: DataFrame, column: str, shares: dict[str, float], by: str | None = None) -> DataFrame:
    """([by], a column for each of `shares`): exact quantiles, interpolated between neighbouring values.

    No task sees all values: a histogram tells the bins that hold the wanted ranks, and only the distinct
    values of those bins, counted before they are shuffled, are put in order.
    """
    group = F.col(by) if by else F.lit(0)
    vals = rows.select(group.alias("g"), F.col(column).cast("double").alias("x")).where("x is not null")
    ends = vals.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("size"))
    ends = ends.withColumn("wanted", F.array_distinct(F.array(*[e for q in shares.values() for e in (F.floor(F.lit(q) * (F.col("size") - 1)), F.ceil(F.lit(q) * (F.col("size") - 1)))])))
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("x") - F.col("low")) / width * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    placed = vals.join(ends.select(F.col("g").alias("h"), "low", "high"), F.col("g").eqNullSafe(F.col("h"))).select("g", "x", at.alias("bin"))
    counts = placed.groupBy("g", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("bin")) - F.col("n")
    counts = counts.withColumn("before", before).join(ends.select(F.col("g").alias("h"), "wanted"), F.col("g").eqNullSafe(F.col("h")))
    held = counts.where(F.exists("wanted", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).select(F.col("g").alias("h"), F.col("bin").alias("b"), "before", "wanted")
    each = placed.join(held, F.col("g").eqNullSafe(F.col("h")) & (F.col("bin") == F.col("b"))).groupBy("g", "bin", "before", "wanted", "x").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("g", "bin").orderBy("x"))
    each = each.withColumn("upto", upto).select("g", "x", F.explode(F.filter("wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))).alias("rank"))
    found = each.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two ranks a share
    found = found.join(ends.select(F.col("g").alias("h"), "size"), F.col("g").eqNullSafe(F.col("h")))
    out = {}
    for name, q in shares.items():
        rank = F.lit(q) * (F.col("size") - 1)
        low, high = F.col("at")[F.floor(rank)], F.col("at")[F.ceil(rank)]
        out[name] = (low + (high - low) * (rank - F.floor(rank))).alias(name)
    return found.select(*([F.col("g").alias(by)] if by else []), *out.values())


def stats(rows: DataFrame, column: str, by: str | None = None, population: bool = False) -> DataFrame:
    c = F.col(column)
    spread = F.stddev_pop(c) if population else F.stddev_samp(c)
    grouped = rows.groupBy(by) if by else rows.groupBy()
    r = lambda x: F.round(x.cast("double"), 6)
    base = grouped.agg(F.count(c).alias("n"), r(F.min(c)).alias("min"), r(F.max(c)).alias("max"), r(F.avg(c)).alias("mean"), r(spread).alias("std"))
    middle = quantiles(rows, column, {"median": 0.5}, by)
    middle = middle.select(*([F.col(by).alias("_by")] if by else []), r(F.col("median")).alias("median"))
    both = base.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left") if by else base.join(middle, F.lit(True), "left")  # one row
    return both.select(*([by] if by else []), "n", "min", "max", "mean", "median", "std")


def quartiles(rows: DataFrame, column: str, by: str) -> DataFrame:
    found = quantiles(rows, column, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, by)
    return found.select(by, *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")])


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) over equal widths from the least to the greatest value; the last bin is closed."""
    c = F.col(column).cast("double")
    ends = rows.agg(F.min(c).alias("low"), F.max(c).alias("high"))
    placed = rows.crossJoin(F.broadcast(ends)).where(c.isNotNull())  # one row
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((c - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def month_spine(rows: DataFrame, date: str) -> DataFrame:
    ends = rows.agg(F.trunc(F.min(date), "month").alias("a"), F.trunc(F.max(date), "month").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("first")).select(dates.month_of(F.col("first")).alias("month"))


def monthly(rows: DataFrame, date: str, low: int) -> DataFrame:
    """(month, n, is_low) of every month from the first to the last, missing ones with 0."""
    per = rows.where(F.col(date).isNotNull()).groupBy(dates.month_of(F.col(date)).alias("month")).agg(F.count("*").alias("n"))
    return month_spine(rows, date).join(per, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < low).alias("is_low"))


def missing_months(rows: DataFrame, date: str, by: str | None = None) -> DataFrame:
    """Months without a row between the first and the last; with `by`, (by, month) for each of its values."""
    months = rows.where(F.col(date).isNotNull()).select(*([by] if by else []), F.trunc(date, "month").alias("first")).distinct()
    ends = months.groupBy(*([by] if by else [])).agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a is not null")
    spine = ends.select(*([by] if by else []), F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("first"))
    gaps = spine.join(months, [*([by] if by else []), "first"], "left_anti")
    return gaps.select(*([by] if by else []), dates.month_of(F.col("first")).alias("month"))


def monthly_relevance(rows: DataFrame, date: str, low: int = 2) -> DataFrame:
    """(month, total, relevant, irrelevant, pct_relevant, is_low) by label."""
    relevant = F.count(F.when(~F.col("label").isin("IRRELEVANT", "NO_EXTRACTION", "UNKNOWN"), 1))
    per = rows.groupBy(dates.month_of(F.col(date)).alias("month")).agg(F.count("*").alias("total"), relevant.alias("relevant"), F.count(F.when(F.col("label") == "IRRELEVANT", 1)).alias("irrelevant"))
    return per.select("month", "total", "relevant", "irrelevant", F.round(F.col("relevant") * 100.0 / F.col("total"), 6).alias("pct_relevant"), (F.col("relevant") < low).alias("is_low"))


def extremes(rows: DataFrame, date: str) -> DataFrame:
    """Months with most and fewest rows, of several the first; first and last day, span in days."""
    per = rows.where(F.col(date).isNotNull()).groupBy(dates.month_of(F.col(date)).alias("month")).agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))
    most, fewest = F.min(F.struct(-F.col("n"), "month")), F.min(F.struct("n", "month"))
    return per.agg(most["month"].alias("most"), fewest["month"].alias("fewest"), F.min("first").alias("first_day"), F.max("last").alias("last_day"), F.datediff(F.max("last"), F.min("first")).alias("span_days"))


def top_by_label(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(label, value, n, rank): the k most frequent elements of an array column for each label."""
    per = exploded(rows, column, "value").groupBy("label", "value").agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def cross_table(rows: DataFrame, column: str, labels: tuple[str, ...], k: int) -> DataFrame:
    """A row for each of the k most frequent elements, a column for each label."""
    each = exploded(rows, column, "value")
    best = top(each, "value", k).select("value")
    return each.join(F.broadcast(best), "value").groupBy("value").pivot("label", list(labels)).count().na.fill(0)  # k rows


def label_months(rows: DataFrame, date: str) -> DataFrame:
    return rows.groupBy("label", dates.month_of(F.col(date)).alias("month")).agg(F.count("*").alias("n"))


def term_frequency(rows: DataFrame, column: str, stopwords: frozenset[str], k: int) -> DataFrame:
    """(term, n): words of more than 3 characters that are no stopword and no number, the k most frequent."""
    raw = rows.select(F.explode(F.split(F.lower(column), "\\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = raw.select(clean_word(F.col("w")).alias("term"), "n")  # each distinct word is cleaned once
    words = words.where((F.length("term") > 3) & ~F.col("term").isin(*sorted(stopwords)) & ~F.col("term").rlike("^[0-9]+$"))
    return words.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def token_cost(rows: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Totals and means of token counts above 0, and the cost at prices a million."""
    a, b = (F.when(F.col(c) > 0, F.col(c)) for c in ("tokens_prompt", "tokens_completion"))
    cost = (F.coalesce(F.sum(a), F.lit(0)) * price_in + F.coalesce(F.sum(b), F.lit(0)) * price_out) / 1e6
    return rows.agg(F.sum(a).alias("prompt"), F.sum(b).alias("completion"), F.round(F.avg(a), 6).alias("mean_prompt"), F.round(F.avg(b), 6).alias("mean_completion"), F.round(cost, 6).alias("cost"))


def estimated_cost(rows: DataFrame, column: str, prompt_tokens: int, output_tokens: int, price_in: float, price_out: float, chars_per_token: float = 4.0) -> DataFrame:
    """What a run over the texts will take, before it starts."""
    tokens = F.sum(F.ceil(F.length(column) / chars_per_token) + prompt_tokens)
    return rows.agg(F.count("*").alias("n"), tokens.cast("long").alias("prompt"), (F.count("*") * output_tokens).alias("completion")).withColumn(
        "cost", F.round((F.col("prompt") * price_in + F.col("completion") * price_out) / 1e6, 6)
    )


def forward_rate(rows: DataFrame) -> DataFrame:
    """Forward-looking, not, and unknown by label, and the rate among the known."""
    f = F.col("is_forward_looking")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    per = rows.groupBy("label").agg(n(f, "yes"), n(~f, "no"), n(f.isNull(), "unknown"))
    return per.withColumn("rate", F.round(F.col("yes") * 100.0 / F.nullif(F.col("yes") + F.col("no"), F.lit(0)), 6))


def discovery_stats(attempts: DataFrame) -> DataFrame:
    """attempts(source, status, n_urls): queries ok, timed out and failed, and URLs, of each source."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return attempts.groupBy("source").agg(n("ok"), n("timeout"), n("error"), F.sum("n_urls").alias("n_urls"))


def overview(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_articles"), F.count_distinct("source").alias("n_sources"), F.count(F.when(~F.col("label").isin("IRRELEVANT", "NO_EXTRACTION", "UNKNOWN"), 1)).alias("n_relevant"),
        F.round(F.avg("char_length"), 6).alias("mean_length"), F.min("published_date").alias("first_day"), F.max("published_date").alias("last_day"), F.round(F.avg("sentiment_score"), 6).alias("mean_score"),
    )


def coverage_pct(rows: DataFrame, date: str, start: Column, end: Column) -> DataFrame:
    """(months, covered, coverage_pct): months of the corpus, those with a row, and their share."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("first")).select(dates.month_of(F.col("first")).alias("month"))
    covered = spine.intersect(rows.where(F.col(date).isNotNull()).select(dates.month_of(F.col(date)).alias("month")))
    both = spine.agg(F.count("*").alias("months")).crossJoin(covered.agg(F.count("*").alias("covered")))  # one row each
    return both.withColumn("coverage_pct", F.round(F.col("covered") * 100.0 / F.col("months"), 1))


def coverage_report(rows: DataFrame, date: str, config) -> DataFrame:
    """One nested record: totals, the first and last day, counts by month of the corpus, thin and missing months, coverage."""
    start, end = F.lit(config.date_start), F.lit(config.date_end)
    per = rows.where(F.col(date).isNotNull()).groupBy(dates.month_of(F.col(date)).alias("month")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("first")).select(dates.month_of(F.col("first")).alias("month"))
    months = spine.join(per, "month", "left").agg(F.array_sort(F.collect_list(F.struct("month", F.coalesce("n", F.lit(0)).alias("n")))).alias("by_month"))  # the months of the corpus
    total = rows.agg(F.count("*").alias("total"), F.struct(F.min(date).alias("start"), F.max(date).alias("end")).alias("date_range"))
    some = lambda test: F.transform(F.filter("by_month", test), lambda m: m.month)
    both = total.crossJoin(months)  # one row each
    return both.select(
        "total", "date_range", "by_month", some(lambda m: (m.n > 0) & (m.n < config.low_coverage)).alias("low_coverage_months"), some(lambda m: m.n == 0).alias("missing_months"),
        F.round(F.size(F.filter("by_month", lambda m: m.n > 0)) * 100.0 / F.size("by_month"), 1).alias("coverage_pct"), F.lit(config.low_coverage).alias("low_coverage_threshold"),
    )

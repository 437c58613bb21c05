"""Extractions: parsing, repair, quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Config

STEPS = tuple(f"step{i}_{n}" for i, n in enumerate("commodities geography event_type temporal sentiment".split(), 1))
PAYLOAD = (
    f"reasoning_chain struct<{', '.join(f'{s}: string' for s in STEPS)}>, label string, sentiment_score double, confidence double, "
    "commodities array<string>, supply_location string, is_forward_looking boolean, rationale string"
)
KINDS = {"label": "string", "sentiment_score": "double", "confidence": "double", "commodities": "array<string>", "supply_location": "string", "is_forward_looking": "boolean", "rationale": "string"}
CLEAN = (
    "article_id url source title published_date full_text char_length keyword_matched label sentiment_score confidence "
    "commodities supply_location is_forward_looking rationale model tokens_prompt tokens_completion extraction_status"
).split()


def bare_json(raw: Column) -> Column:
    """What stands between code fences, if there are any."""
    fenced = F.regexp_extract(raw, "(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.trim(F.when(F.contains(raw, F.lit("```")), fenced).otherwise(raw))


def parsed(raw: Column) -> Column:
    """The object as a variant: the first of a list, {} for an empty list, NULL if it isn't JSON."""
    value = F.try_parse_json(bare_json(raw))
    kind = F.schema_of_variant(value)
    first = F.try_variant_get(value, "$[0]", "variant")
    return F.when(kind.startswith("ARRAY"), F.coalesce(first, F.parse_json(F.lit("{}")))).otherwise(value)


def repaired(raw: Column) -> Column:
    """A struct of the payload: fields misplaced in reasoning_chain promoted where absent on top, gaps filled.

    A field that is present on top with a JSON null stays null. Scores are clamped.
    """
    value = parsed(raw)
    absent = lambda key: ~F.exists(F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>")), lambda k: k == key)

    def field(key: str, default: Column) -> Column:
        kind = KINDS[key]
        own, inner = F.try_variant_get(value, f"$.{key}", kind), F.try_variant_get(value, f"$.reasoning_chain.{key}", kind)
        return F.when(absent(key), F.coalesce(inner, default)).otherwise(own)

    chain = F.try_variant_get(value, "$.reasoning_chain", f"struct<{', '.join(f'{s}: string' for s in STEPS)}>")
    filled = F.struct(*[F.coalesce(chain[s], F.lit("auto-filled")).alias(s) for s in STEPS])
    built = F.struct(
        filled.alias("reasoning_chain"),
        field("label", F.lit("IRRELEVANT")).alias("label"),
        clamp(F.coalesce(field("sentiment_score", F.lit(0.0)), F.lit(0.0)), -1, 1).alias("sentiment_score"),
        clamp(F.coalesce(field("confidence", F.lit(0.0)), F.lit(0.0)), 0, 1).alias("confidence"),
        field("commodities", F.array().cast("array<string>")).alias("commodities"),
        field("supply_location", F.lit(None).cast("string")).alias("supply_location"),
        field("is_forward_looking", F.lit(False)).alias("is_forward_looking"),
        field("rationale", F.lit("auto-filled")).alias("rationale"),
    )
    return F.when(value.isNotNull(), built)


def violations(payload: Column, labels: tuple[str, ...]) -> Column:
    """Names of the schema's rules that a payload struct breaks."""
    p = payload
    rules = {
        "reasoning_chain": p.reasoning_chain.isNull() | F.exists(F.array(*[p.reasoning_chain[s].isNull() for s in STEPS]), lambda x: x),
        "label": ~F.coalesce(p.label.isin(*labels), F.lit(False)),
        "sentiment_score": ~F.coalesce(p.sentiment_score.between(-1, 1), F.lit(False)),
        "confidence": ~F.coalesce(p.confidence.between(0, 1), F.lit(False)),
        "commodities": p.commodities.isNull(),
        "is_forward_looking": p.is_forward_looking.isNull(),
        "rationale": ~F.coalesce(F.length(p.rationale) <= 1000, F.lit(False)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def clamp(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which least and greatest alone would not keep."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low))))


def latest_by_id(cache: DataFrame, position: str = "pos") -> DataFrame:
    """The last row of each article_id; rows without one are dropped."""
    order = Window.partitionBy("article_id").orderBy(F.desc(position))
    return cache.where("article_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def joined(articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """Inner join on article_id; a column of both keeps the article's and gets `_ext` for the other."""
    both = [c for c in extractions.columns if c in articles.columns and c != "article_id"]
    return articles.join(extractions.withColumnsRenamed({c: f"{c}_ext" for c in both}), "article_id")


def quality_controlled(rows: DataFrame, config: Config) -> DataFrame:
    """Low confidence becomes irrelevant, failures go, scores are clamped, unknown labels become irrelevant."""
    label = F.when(F.col("confidence") < config.confidence, config.fallback_label).otherwise(F.col("label"))
    rows = rows.withColumn("label", label).where("extraction_status = 'success'")
    rows = rows.withColumns({"sentiment_score": clamp(F.col("sentiment_score"), *config.score_range), "confidence": clamp(F.col("confidence"), 0, 1)})
    return rows.withColumn("label", F.when(F.col("label").isin(*config.labels), F.col("label")).otherwise(config.fallback_label))


def pruned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are, in that order."""
    return rows.select(*[c for c in columns if c in rows.columns])


def for_exploration(articles: DataFrame, extractions: DataFrame, position: str | None = None) -> DataFrame:
    """Left join; articles without an extraction get NO_EXTRACTION, extractions without a label UNKNOWN.

    Of several extractions of one article the last by `position` counts; without it they are taken as
    they come, one for each article.
    """
    if position is not None:
        extractions = latest_by_id(extractions, position)
    marked = extractions.withColumn("_found", F.lit(True))
    label = F.when(F.col("_found").isNull(), "NO_EXTRACTION").otherwise(F.coalesce("label", F.lit("UNKNOWN")))
    return articles.join(marked, "article_id", "left").withColumn("label", label).drop("_found")


def repaired_cache(cache: DataFrame) -> DataFrame:
    """Only what succeeded, so that the rest is tried again."""
    return cache.where("status = 'success'")


def failure(error: str = "max_retries") -> Column:
    """The payload of an extraction that failed for good."""
    return F.struct(
        F.struct(*[F.lit("failed").alias(s) for s in STEPS]).alias("reasoning_chain"), F.lit("IRRELEVANT").alias("label"), F.lit(0.0).alias("sentiment_score"), F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("commodities"), F.lit(None).cast("string").alias("supply_location"), F.lit(False).alias("is_forward_looking"), F.lit(error).alias("rationale"),
    )


def failure_record(articles: DataFrame, model: str, error: str = "max_retries") -> DataFrame:
    """The record of articles whose extraction failed for good."""
    return articles.select(
        "article_id", failure(error).alias("extraction"), F.lit(model).alias("model"), F.lit(0).cast("long").alias("tokens_prompt"), F.lit(0).cast("long").alias("tokens_completion"), F.current_timestamp().alias("extracted_at"), F.lit("failed").alias("status")
    )


def label_code(label: Column, labels: tuple[str, ...]) -> Column:
    """Number of a label in the order of `labels`; NULL for others."""
    return F.element_at(F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))]), label)

"""Quality rules: bands of character n-gram perplexity, set for each language.

Spark counts the 5-grams of all texts of a language; a modified Kneser-Ney model of them, kept in
sorted hash arrays, gives each text its nats a symbol and its perplexity. Each text is scored twice:
by a model of the folds it is not in (`perplexity`), which tells noise and other languages, and by a
model of all texts (`seen_perplexity`), its own among them, under which repetitive and templated texts
stand out as too well known. Each score has a band for each language: it is centred on the median of
all its documents; its half-width is `deviations` times the error, which joins the spread between
documents (1.4826 x median absolute deviation, from a histogram of steps of 1e-4 nats over all
documents) with the model's variance a symbol divided by the text's length. The spread of the first score is
taken as HELD_SPREAD of the median at least. A document must lie in both bands. A language with too few texts to split (`heldout.scarce`) is scored by all its texts both
times.

Defined results: documents with a null language form a language of their own, `und`, together with any
that name it; the edges of a band belong to it; null and empty texts
have no perplexity and are rejected; repeated rows are each scored; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.heldout import folds, scarce
from tidewater.llm.kneser_ney import ORDER, KneserNey, counted, groups_of
from tidewater.llm.textscan import let_go
from tidewater.operators.lineage import keep

DEVIATIONS, LEAST_SPREAD, STEP = 6.0, 0.01, 1e-4
#: Least spread, as a share of the median, of what held-out models say: whole documents may have a passage in another language.
HELD_SPREAD = 0.12
MODEL_BYTES = 1 << 30
SCORE_BYTES = 1 << 19
UNKNOWN = "und"


def fit(docs: DataFrame, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> Iterator[dict[str, KneserNey]]:
    """Models for the languages of docs(lang, text), in groups of at most `model_bytes`.

    The driver gets the distinct 5-grams of one group at a time, bounded by its scripts and not by the number of
    documents; their number is known before any of them is fetched. A text needs the model of its own
    language only, so groups change nothing but what is held at once.
    """
    with counted(docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text"), "raw", order) as (counts, sizes):
        for group in groups_of(sizes, model_bytes, joint=False):
            table = counts.where(F.col("lang").isin(group)).toArrow()
            models = {}
            for lang in group:
                own = table.filter(pc.equal(table["lang"], lang))
                models[lang] = KneserNey([lang], np.zeros(own.num_rows, np.int64), own["code"].to_numpy().view(np.uint64), own["n"].to_numpy(), order, modified=True)
            yield models


def entropy(spark: SparkSession, models: dict[str, KneserNey]):
    """A function of (language, text): struct(nats a symbol, symbols)."""
    shared = spark.sparkContext.broadcast(models)
    fields = [pa.field("nats", pa.float64()), pa.field("symbols", pa.int64())]

    @F.arrow_udf("struct<nats:double,symbols:long>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        models = shared.value
        for langs, texts in batches:
            nats, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for lang in pc.unique(langs).to_pylist():
                if lang in models:
                    rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
                    value, size = models[lang].cross_entropy(texts.take(pa.array(rows)), "raw", SCORE_BYTES)
                    nats[rows], sizes[rows] = value[:, 0], size
            yield pa.StructArray.from_arrays([pa.array(nats, mask=sizes == 0), pa.array(sizes)], fields=fields)
        del models
        let_go(shared)

    return run


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    order = np.argsort(values)
    total = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(total, q * total[-1])])


def bands(scored: DataFrame, least_spread: float = LEAST_SPREAD) -> dict[str, tuple[float, float]]:
    """(median, spread) of nats a symbol for each language, from a histogram over all documents."""
    steps = scored.where("symbols > 0").groupBy("lang", F.round(F.col("nats") / STEP).cast("long").alias("step")).count().toArrow().to_pandas()
    out = {}
    for lang, own in steps.groupby("lang"):
        value, count = own["step"].to_numpy() * STEP, own["count"].to_numpy()
        middle = _quantile(value, count, 0.5)
        out[lang] = (middle, max(1.4826 * _quantile(np.abs(value - middle), count, 0.5), least_spread * middle))
    return out


def _banded(spark: SparkSession, models: Iterator[tuple[Iterator[dict[str, KneserNey]], DataFrame]], deviations: float, least_spread: float) -> DataFrame:
    """(doc_id, lang, text_key, symbols, nats, lower, upper): the rows of each part under its models, in the band of them all."""
    parts, variance = [], {}
    for fitted, rows in models:
        rows = rows.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text")
        seen: list[str] = []
        for own in fitted:
            scored = rows.where(F.col("lang").isin(list(own))).select("doc_id", "lang", "text_key", entropy(spark, own)("lang", "text").alias("s"))
            parts.append(keep(scored.select("doc_id", "lang", "text_key", "s.nats", "s.symbols")))
            seen += own
            for lang, model in own.items():
                variance[lang] = max(variance.get(lang, 0.0), float(model.variance[0]))
        rest = rows.where(~F.col("lang").isin(seen)) if seen else rows
        parts.append(rest.select("doc_id", "lang", "text_key", F.lit(None).cast("double").alias("nats"), F.lit(0).cast("long").alias("symbols")))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionAll(part)
    limits = bands(scored, least_spread)
    rows = [(k, *limits[k], v) for k, v in variance.items() if k in limits]
    table = F.broadcast(spark.createDataFrame(rows, "lang string, middle double, spread double, variance double"))  # a row a language
    width = F.lit(deviations) * F.sqrt(F.col("spread") * F.col("spread") + F.col("variance") / F.greatest("symbols", F.lit(1)))
    return scored.join(table, "lang", "left").select("doc_id", "lang", "text_key", "symbols", "nats", (F.col("middle") - width).alias("lower"), (F.col("middle") + width).alias("upper"))


def perplexity_rules(docs: DataFrame, deviations: float = DEVIATIONS, least_spread: float = LEAST_SPREAD, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(doc_id, lang, symbols, perplexity, lower, upper, seen_perplexity, seen_lower, seen_upper, keep) of every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    held = _banded(spark, ((fit(learn, model_bytes=model_bytes), rows) for learn, rows in folds(docs, scarce(docs))), deviations, max(least_spread, HELD_SPREAD))
    seen = _banded(spark, iter([(fit(docs, model_bytes=model_bytes), docs)]), deviations, least_spread)
    # a score follows from language and text, so one of equal texts stands for all
    seen = seen.groupBy("lang", "text_key").agg(*[F.first(c).alias(f"seen_{c}") for c in ("nats", "lower", "upper")])
    inside = F.col("nats").between(F.col("lower"), F.col("upper")) & F.col("seen_nats").between(F.col("seen_lower"), F.col("seen_upper"))
    return held.join(seen, ["lang", "text_key"], "left").select(
        "doc_id", "lang", "symbols", F.exp("nats").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"),
        F.exp("seen_nats").alias("seen_perplexity"), F.exp("seen_lower").alias("seen_lower"), F.exp("seen_upper").alias("seen_upper"),
        F.coalesce(inside & (F.col("symbols") > 0), F.lit(False)).alias("keep"),
    )

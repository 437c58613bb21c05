"""From pages and discoveries to accepted and rejected articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.functions import dates, text, web


def route(found: DataFrame, config: Config) -> DataFrame:
    """found(url, title, full_text, published) with `published_date` and `disposition`.

    The first that applies: no_text, length_out_of_range:<n>, date_unknown, out_of_range (dropped
    without a reason in the rejected table), geo_irrelevant, accepted.
    """
    size = F.length("full_text")
    date = F.coalesce(F.nullif(F.trim("published"), F.lit("")), dates.date_from_url(F.col("url")))
    day = dates.parse_pub_date(date)
    whole = F.concat_ws(" ", "full_text", F.coalesce("title", F.lit("")))
    known = found.withColumn("published_date", F.when(F.coalesce(day, F.lit("")) != "", day))
    exact = F.try_to_timestamp("published_date", F.lit("yyyy-MM-dd")).cast("date")
    return known.withColumn(
        "disposition",
        F.when(F.coalesce(size, F.lit(0)) == 0, "no_text")
        .when(~size.between(config.min_length, config.max_length), F.concat(F.lit("length_out_of_range:"), size.cast("string")))
        .when(F.col("published_date").isNull(), "date_unknown")
        .when(~F.coalesce(exact.between(F.lit(config.date_start), F.lit(config.date_end)), F.lit(False)), "out_of_range")
        .when(text.term_hits(whole, config.places) < 1, "geo_irrelevant")
        .otherwise("accepted"),
    )


def accepted(routed: DataFrame, config: Config) -> DataFrame:
    whole = F.concat_ws(" ", "full_text", F.coalesce("title", F.lit("")))
    return routed.where("disposition = 'accepted'").select(
        web.article_id(F.col("url"), F.col("published_date")).alias("article_id"), "url", "source", "title", F.col("published_date").cast("date").alias("published_date"), F.current_date().alias("crawled_date"), "full_text",
        F.length("full_text").cast("long").alias("char_length"), text.phrases_in(whole, config.primary + config.secondary).alias("keyword_matched"),
        *[F.coalesce(c, F.lit(d)).alias(c) if c in routed.columns else F.lit(d).alias(c) for c, d in (("source_keyword", ""), ("source_name", "unknown"))],
        text.phrases_in(whole, config.commodities).alias("commodities_mentioned"),
    )


def rejected(routed: DataFrame) -> DataFrame:
    """Out-of-range articles leave no record."""
    return routed.where("disposition not in ('accepted', 'out_of_range')").select("url", "source", "published_date", F.col("disposition").alias("rejection_reason"), "title")


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    order = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def keep_longest(articles: DataFrame, key: str = "url", length: str = "char_length", position: str = "pos") -> DataFrame:
    """The longest article of each key; of equally long ones the first."""
    order = Window.partitionBy(key).orderBy(F.desc(length), position)
    return articles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def tasks(sources: DataFrame, keywords: DataFrame, done: DataFrame) -> DataFrame:
    """Every enabled source with every keyword, by priority, without the pairs done already."""
    grid = sources.where("enabled").crossJoin(keywords).withColumn("task", F.concat_ws("::", "source_key", "keyword"))
    return not_done(grid, done, "task").orderBy(F.coalesce("priority", F.lit(99)), "source_key", "keyword")


def cleaned(articles: DataFrame, config: Config) -> DataFrame:
    """Length and letter filters before any comparison of texts; articles have pos, full_text, char_length."""
    kept = articles.where(F.coalesce("char_length", F.lit(0)).between(config.min_length, config.max_length))
    return kept.where(~text.is_gibberish(F.col("full_text"), config.min_letter_ratio))


def finished(articles: DataFrame, config: Config, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Relevant articles with text normalised, then cut; their length is not checked again.

    With `embed` and config.semantic, articles that name a place and whose meaning is near a primary
    keyword are relevant too.
    """
    by_words = text.relevant(F.col("full_text"), F.col("title"), config.primary, config.places)
    if config.semantic and embed is not None:
        near = semantic_score(embed, config.primary)(semantic_text(F.col("title"), F.col("full_text"))) >= config.semantic_threshold
        place = text.term_hits(F.concat_ws(" ", "full_text", "title"), config.places) > 0
        marked = articles.withColumn("_words", by_words)
        # only what words leave open is embedded
        kept = marked.where("_words").union(marked.where(~F.coalesce("_words", F.lit(False))).where(place).where(near)).drop("_words")
    else:
        kept = articles.where(by_words)
    body = text.truncate_at_sentence(text.normalize_text(F.col("full_text")), config.max_length)
    return kept.withColumn("full_text", body).withColumn("char_length", F.length("full_text").cast("long"))


def semantic_text(title: Column, full_text: Column) -> Column:
    """What stands for an article's meaning: its title and its first 500 characters."""
    return F.concat_ws(". ", F.coalesce(title, F.lit("")), F.left(F.coalesce(full_text, F.lit("")), F.lit(500)))


def semantic_score(embed: Callable[[list[str]], list[list[float]]], phrases: tuple[str, ...]):
    """A function of a text column: the greatest cosine with a phrase. The phrases are embedded once a batch's worker."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = np.asarray(embed(list(phrases)), dtype=np.float64)
        keys /= np.maximum(np.linalg.norm(keys, axis=1, keepdims=True), 1e-12)
        for texts in batches:
            x = np.asarray(embed([t or "" for t in texts.to_pylist()]), dtype=np.float64).reshape(len(texts), -1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pa.array((x @ keys.T).max(axis=1) if len(texts) else np.zeros(0))

    return score


def with_metadata(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """urls(url) with title, source_keyword and source_name of metadata, or their defaults."""
    own = metadata.select("url", *[F.col(c).alias(f"_{c}") for c in ("title", "source_keyword", "source_name")])
    defaults = {"title": "", "source_keyword": "", "source_name": "unknown"}
    return urls.join(own, "url", "left").select(*[c for c in urls.columns if c not in defaults], *[F.coalesce(f"_{c}", F.lit(d)).alias(c) for c, d in defaults.items()])


def all_urls(*tables: DataFrame) -> DataFrame:
    """(url): every URL of the tables once."""
    out = tables[0].select("url")
    for table in tables[1:]:
        out = out.unionAll(table.select("url"))
    return out.where("url is not null").distinct()


def not_fetched(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """urls(url) of which the cache pages(cache_key, ..) has no page."""
    return urls.withColumn("_key", web.cache_key(F.col("url"))).join(pages.select(F.col("cache_key").alias("_key")), "_key", "left_anti").drop("_key")


def cached_pages(fetched: DataFrame) -> DataFrame:
    """(cache_key, url, body) of fetched(url, status, body) that came."""
    return fetched.where("status = 200").select(web.cache_key(F.col("url")).alias("cache_key"), "url", "body")


def articles_of(pages: DataFrame) -> DataFrame:
    """(url, source, full_text, page_title, published) of pages(url, body)."""
    body = F.col("body")
    return pages.select("url", web.domain(F.col("url")).alias("source"), web.main_text(body).alias("full_text"), web.page_title(body).alias("page_title"), web.page_date(body).alias("published"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, nth, link): the links of each page in order, made absolute."""
    found = pages.select("page_id", "url", F.posexplode(web.links(F.col("html"))).alias("nth", "link"))
    return found.select("page_id", (F.col("nth") + 1).alias("nth"), web.absolute(F.col("link"), F.col("url")).alias("link"))


def rss_in_range(items: DataFrame, config: Config) -> DataFrame:
    """Items(.., published) dated within the corpus; undated ones stay."""
    day = F.to_date(F.nullif(dates.parse_pub_date(F.col("published")), F.lit("")))
    return items.withColumn("pub_date", day).where(F.coalesce(F.col("pub_date").between(F.lit(config.date_start), F.lit(config.date_end)), F.lit(True)))


def semantic_matches(articles: DataFrame, keywords: DataFrame, threshold: float) -> DataFrame:
    """articles(vec_id, embedding) whose best cosine with a row of keywords(keyword, embedding) reaches the threshold.

    The keywords are a fixed, short list, so they ride along as one array.
    """
    listed = keywords.agg(F.collect_list(F.struct("keyword", F.col("embedding").alias("e"))).alias("keys"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    own = F.col("embedding")
    scored = articles.crossJoin(F.broadcast(listed)).withColumn("best", F.array_max(F.transform("keys", lambda k: dot(own, k.e) / F.sqrt(dot(own, own) * dot(k.e, k.e)))))
    return scored.where(F.col("best") >= threshold).drop("keys")

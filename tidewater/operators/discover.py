"""Search pages of sites: which to ask for, how far to read them, and which of their links are articles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.functions import dates, web


def has_any(*parts: str) -> Callable[[Column], Column]:
    """A test whether a URL has one of the parts."""

    def test(url: Column) -> Column:
        found = F.contains(url, F.lit(parts[0]))
        for part in parts[1:]:
            found = found | F.contains(url, F.lit(part))
        return found

    return test


@dataclass(frozen=True)
class Site:
    """How the links of a source's search pages become articles."""

    base_url: str
    accepts: Callable[[Column], Column]


#: By the key of a source; other sources take every link below their own base URL.
SITES: dict[str, Site] = {
    **dict.fromkeys(("antaranews", "antaranews_sumut"), Site("https://www.antaranews.com", has_any("/berita/"))),
    **dict.fromkeys(("detik", "detik_sumut"), Site("https://www.detik.com", lambda url: has_any("detik.com")(url) & has_any("/d-", "/berita/")(url))),
    "kompas": Site("https://www.kompas.com", has_any("kompas.com", "kompas.id")),
    "tribunnews": Site("https://www.tribunnews.com", has_any("tribunnews.com", "tribunmedan.com")),
    "waspada": Site("https://www.waspada.id", has_any("waspada.id")),
}


def search_pages(tasks: DataFrame, config: Config) -> DataFrame:
    """(source_key, keyword, page, url): the pages to ask for, 1 to max_pages, of tasks(source_key, keyword)."""
    spark = tasks.sparkSession
    known = spark.createDataFrame([(s.key, s.search_url) for s in config.sources], "source_key string, template string")
    page = F.explode(F.sequence(F.lit(1), F.lit(config.max_pages)))
    rows = tasks.join(known, "source_key").select("source_key", "keyword", "template", page.alias("page"))
    return rows.select("source_key", "keyword", "page", web.filled(F.col("template"), F.col("keyword"), F.col("page")).alias("url"))


def accepted_links(results: DataFrame, config: Config, sites: dict[str, Site] = SITES) -> DataFrame:
    """(source_key, keyword, page, links): of each page the links that its site accepts, absolute, each once, with titles."""
    base, accepts = F.lit(""), F.lit(True)
    url = F.col("link.url")
    for source in config.sources:
        site = sites.get(source.key)
        own = F.col("source_key") == source.key
        root = site.base_url if site and not source.base_url else source.base_url
        base = F.when(own, F.lit(root.rstrip("/"))).otherwise(base)
        accepts = F.when(own, site.accepts(url) if site else url.startswith(root)).otherwise(accepts)
    ok = F.col("status") == 200
    each = results.select("source_key", "keyword", "page", ok.alias("ok"), F.posexplode_outer(F.when(ok, web.anchors(F.col("body")))).alias("at", "anchor"))
    href = F.trim(F.col("anchor.href"))
    each = each.withColumn("link", F.struct(F.when(href.startswith("/"), F.concat(base, href)).otherwise(href).alias("url"), F.col("anchor.title").alias("title"))).withColumn("good", F.coalesce(accepts, F.lit(False)) & F.col("anchor").isNotNull())
    return each.groupBy("source_key", "keyword", "page").agg(F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("at", "link")))).alias("links"), F.bool_and("ok").alias("ok"))  # the links of a page


def discovered(results: DataFrame, config: Config, sites: dict[str, Site] = SITES) -> DataFrame:
    """(url, title, source_keyword, source_name): what the pages list before the first that failed or is empty.

    results(source_key, keyword, page, status, body); of a URL the first row counts, by priority of its
    source, keyword, page and place.
    """
    pages = accepted_links(results, config, sites)
    upto = pages.groupBy("source_key", "keyword").agg(F.min(F.when(~F.col("ok") | (F.size("links") == 0), F.col("page"))).alias("stop"))
    read = pages.join(upto, ["source_key", "keyword"]).where("stop is null or page < stop")
    names = pages.sparkSession.createDataFrame([(s.key, s.name, s.priority) for s in config.sources], "source_key string, source_name string, priority int")
    rows = read.join(names, "source_key", "left").select("source_key", "keyword", "page", "source_name", "priority", F.explode("links").alias("l"))
    rows = rows.select(F.col("l.link.url").alias("url"), F.col("l.link.title").alias("title"), F.col("keyword").alias("source_keyword"), F.coalesce("source_name", "source_key").alias("source_name"), "priority", "page", F.col("l.at").alias("at"))
    order = Window.partitionBy("url").orderBy("priority", "source_name", "source_keyword", "page", "at")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("url", "title", "source_keyword", "source_name")


def outcomes(results: DataFrame) -> DataFrame:
    """(source, status, n_urls) of each query: ok, timeout or error; status 0 with a body that names a timeout is one."""
    n = F.size(web.links(F.col("body")))
    kind = F.when(F.col("status") == 200, "ok").when((F.col("status") == 0) & F.lower("body").contains("time"), "timeout").otherwise("error")
    return results.select(F.col("source_key").alias("source"), "keyword", kind.alias("status"), F.when(F.col("status") == 200, n).otherwise(0).alias("n_urls"))


def feed_results(results: DataFrame, config: Config) -> DataFrame:
    """(url, title, published, source_keyword) of feeds in results(keyword, status, body), redirects resolved, within the corpus; undated items stay."""
    items = results.where("status = 200").select("keyword", F.explode(web.feed_items(F.col("body"))).alias("i")).where("trim(i.url) <> ''")
    day = F.to_date(F.nullif(dates.parse_pub_date(F.col("i.published")), F.lit("")))
    inside = F.coalesce(day.between(F.lit(config.date_start), F.lit(config.date_end)), F.lit(True))
    return items.where(inside).select(web.redirect_target(F.trim("i.url")).alias("url"), "i.title", "i.published", F.col("keyword").alias("source_keyword"))


def progress(tasks: DataFrame) -> DataFrame:
    """(task) as the table of finished queries holds it."""
    return tasks.select(F.concat_ws("::", "source_key", "keyword").alias("task")).distinct()

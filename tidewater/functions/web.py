"""Identifiers, URLs and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_id(url: Column, date: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", url, date), 256), 1, 16)


def cache_key(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def domain(url: Column) -> Column:
    """The authority, with port and user, without every `www.`."""
    return F.replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def search_url(template: str, keyword: Column, page: Column) -> Column:
    """template with {q} replaced by the quoted keyword and {page} by the number."""
    return F.replace(F.replace(F.lit(template), F.lit("{q}"), F.url_encode(keyword)), F.lit("{page}"), page.cast("string"))


def filled(template: Column, keyword: Column, page: Column) -> Column:
    """template with {query} replaced by the quoted keyword and {page} by the number."""
    return F.replace(F.replace(template, F.lit("{query}"), F.url_encode(keyword)), F.lit("{page}"), page.cast("string"))


def anchors(html: Column) -> Column:
    """Anchors in order of appearance, those of one target once: array of struct(href, title)."""
    raw = F.regexp_extract_all(html, F.lit("(?is)<a[^>]*\\shref=[\"'][^\"'#]+[\"'][^>]*>.*?</a>"), F.lit(0))
    href = lambda a: F.regexp_extract(a, "(?is)<a[^>]*\\shref=[\"']([^\"'#]+)[\"']", 1)
    title = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]+>", " "), "\\s+", " "))
    each = F.transform(raw, lambda a: F.struct(href(a).alias("href"), title(a).alias("title")))
    return F.filter(each, lambda a, i: F.array_position(F.transform(each, lambda x: x.href), a.href) == i + 1)


def feed_items(body: Column) -> Column:
    """Items of a feed: array of struct(title, url, published)."""
    raw = F.regexp_extract_all(body, F.lit("(?is)<item\\b[^>]*>(.*?)</item>"), F.lit(1))
    part = lambda x, tag: F.trim(F.regexp_replace(F.regexp_extract(x, f"(?is)<{tag}\\b[^>]*>(?:\\s*<!\\[CDATA\\[)?(.*?)(?:\\]\\]>\\s*)?</{tag}>", 1), "&amp;", "&"))
    return F.transform(raw, lambda x: F.struct(part(x, "title").alias("title"), part(x, "link").alias("url"), part(x, "pubDate").alias("published")))


def redirect_target(url: Column) -> Column:
    """The URL that an aggregator's redirect carries in its path, as Base64; others stay."""
    token = F.regexp_extract(url, "/rss/articles/([A-Za-z0-9_-]+)", 1)
    whole = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    target = F.regexp_extract(F.try_to_binary(whole, F.lit("base64")).cast("string"), "(https?://[\\x21-\\x7e]+)", 1)
    return F.when((token != "") & (F.coalesce(target, F.lit("")) != ""), target).otherwise(url)


def links(html: Column) -> Column:
    """Distinct targets of anchors in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)<a[^>]*\\shref=[\"']([^\"'#]+)[\"']"), F.lit(1)))


def absolute(link: Column, base: Column) -> Column:
    """link as seen from the page `base`."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat_ws("/", folder, link))
    )


def main_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, comments and tags; white space collapsed."""
    html = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "header", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, "(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(html, "\\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def page_date(html: Column) -> Column:
    """The content of a publication date in the page's metadata, else ''."""
    return F.regexp_extract(html, "(?is)<(?:meta|time)[^>]*(?:published_time|datePublished|pubdate|datetime)[^>]*?(?:content=|datetime=)?[\"']([0-9]{4}-[0-9]{2}-[0-9]{2}[^\"']*)[\"']", 1)

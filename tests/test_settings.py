"""Settings files, discovery, the search source, waves of paid calls."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

import pytest

from tests import client  # noqa: F401 - the sources import it by name
from tidewater.config import Config, Source, read_yaml
from tidewater.functions import web
from tidewater.operators import collect, discover, extraction, validation
from tidewater.sources import crawl, tables

SECTIONS = """
# a project
project:
  name: "x # y"
corpus:
  date_start: "2022-01-01"   # first day
  min_length_chars: 300
keywords:
  primary:
    - "rice town"
    # a comment between
    - 'fish: town'
  geo_terms: [north, "south east"]
scrapers:
  rate_limit_sec: 2.5
  sources:
    kompas:
      enabled: true
      name: "K"
      search_url: "https://k.example/?q={query}&p={page}"
      priority: 2
    other:
      enabled: false
      search_url: "https://o.example/{query}"
llm:
  provider: "gemini"
  batch_size: 7
labels:
  valid:
  - "A"
  - "B"
sentiment:
  score_min: -2.0
  score_max: 2
aggregation:
  decay_lambda: 0.1
  analysis_period_start: "2023-01-01"
"""


def test_sections(tmp_path):
    (tmp_path / "config.yaml").write_text(SECTIONS)
    config = Config.read(str(tmp_path / "config.yaml"))
    assert config.date_start == dt.date(2022, 1, 1) and config.analysis_start == dt.date(2023, 1, 1) and config.min_length == 300
    assert config.primary == ("rice town", "fish: town") and config.places == ("north", "south east") and config.labels == ("A", "B")
    assert config.score_range == (-2.0, 2.0) and config.decay == 0.1 and config.interval == 2.5 and config.flush_every == 7
    assert (config.price_in, config.price_out) == (0.075, 0.3)
    assert config.sources == (Source("kompas", "K", "https://k.example/?q={query}&p={page}", priority=2), Source("other", "other", "https://o.example/{query}", enabled=False))
    assert any("1 sources: K" in line for line in config.summary())
    assert read_yaml(SECTIONS)["project"]["name"] == "x # y"
    with pytest.raises(FileNotFoundError):
        Config.read(str(tmp_path / "none.yaml"))
    with pytest.raises(ValueError):
        read_yaml("a: 1\n  b: 2")


def test_flat_settings(tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"anchor": "2020-05-01", "labels": ["X"]}))
    assert Config.read(str(tmp_path / "flat.json")) == replace(Config(), anchor=dt.date(2020, 5, 1), labels=("X",))
    with pytest.raises(KeyError):
        Config.of({"no_such": 1})


def test_keys_and_consent():
    assert extraction.service_key("openai", {"OPENAI_API_KEY": "k1"}) == "k1"
    for bad in ({}, {"OPENAI_API_KEY": "sk-..."}, {"OPENAI_API_KEY": "your key"}):
        assert extraction.service_key("openai", bad, skip=True) is None
        with pytest.raises(extraction.MissingKey):
            extraction.service_key("openai", bad)
    assert extraction.agreed(1.5, None) == 1.5 and extraction.agreed(1.5, lambda cost: cost < 2) == 1.5
    with pytest.raises(extraction.Declined):
        extraction.agreed(1.5, lambda cost: False)


def test_waves_are_all_rows(spark, tmp_path):
    rows = spark.range(100).selectExpr("id as article_id")
    parts = list(extraction.waves(rows, "article_id", 30))
    assert len(parts) == 4 and sorted(r[0] for p in parts for r in p.collect()) == list(range(100))
    assert list(extraction.waves(rows.limit(0), "article_id", 30)) == [] and len(list(extraction.waves(rows, "article_id", 1, most=5))) == 5

    def failing():
        yield parts[0]
        raise RuntimeError("the service is down")

    with pytest.raises(RuntimeError):
        tables.append_in_waves(failing(), str(tmp_path / "cache"))
    assert spark.read.json(str(tmp_path / "cache")).count() == parts[0].count()  # the first wave is saved


def test_search_source_stops(spark):
    spark.dataSource.register(crawl.SearchSource)
    tasks = [{"source_key": "kompas", "keyword": k, "template": f"https://{d}.example/{{query}}/{{page}}"} for d, k in (("a", "two pages"), ("a", "none"), ("b", "broken"))]
    load = lambda **more: spark.read.format("tidewater_search").options(tasks=json.dumps(tasks), client="tests.client:search", max_pages=5, interval=0, backoff=0, retries=1, **more).load().collect()
    got = sorted((r["keyword"], r["page"], r["status"]) for r in load())
    assert got == [("broken", 1, 500), ("none", 1, 200), ("two pages", 1, 200), ("two pages", 2, 200), ("two pages", 3, 200)]
    assert all(r["status"] == 0 and r["body"] == "time limit" for r in load(total_seconds=-1))


def test_discovery_stops_at_the_first_empty_page(spark):
    config = replace(Config(), sources=(Source("kompas", "K", "s", priority=2), Source("detik", "D", "s", "https://d.example", priority=1)))
    good = '<a href="/read/1"> one <b>two</b></a><a href="https://www.kompas.com/2">2</a><a href="/read/1">again</a><a href="https://x.example">x</a>'
    rows = [
        ("kompas", "q", 1, 200, good), ("kompas", "q", 2, 200, '<a href="https://kompas.com/3">3</a>'), ("kompas", "q", 3, 200, "nothing"), ("kompas", "q", 4, 200, '<a href="https://kompas.com/4">4</a>'),
        ("detik", "q", 1, 200, '<a href="https://www.detik.com/berita/5">5</a><a href="https://www.detik.com/about">6</a><a href="https://www.kompas.com/detik.com/d-7">7</a>'), ("detik", "r", 1, 500, good), ("kompas", "none", 1, 200, None),
    ]
    found = discover.discovered(spark.createDataFrame(rows, "source_key string, keyword string, page int, status int, body string"), config)
    assert {tuple(r) for r in found.collect()} == {
        ("https://www.kompas.com/read/1", "one two", "q", "K"), ("https://www.kompas.com/2", "2", "q", "K"), ("https://kompas.com/3", "3", "q", "K"),
        ("https://www.detik.com/berita/5", "5", "q", "D"), ("https://www.kompas.com/detik.com/d-7", "7", "q", "D"),
    }
    counted = discover.outcomes(spark.createDataFrame([("a", "q", 1, 200, good), ("a", "q", 2, 0, "time limit"), ("a", "q", 3, 404, "")], "source_key string, keyword string, page int, status int, body string"))
    assert [tuple(r)[2:] for r in counted.collect()] == [("ok", 3), ("timeout", 0), ("error", 0)]
    assert {r[0] for r in discover.progress(spark.createDataFrame([("a", "k")], "source_key string, keyword string")).collect()} == {"a::k"}


def test_feeds_and_redirects(spark):
    token = "CBMiHmh0dHBzOi8vYS5leGFtcGxlL25ld3MvMTIzNDU2"  # two bytes, then a URL
    body = f"<rss><item><title>A &amp; B</title><link>https://feeds.example/rss/articles/{token}?oc=5</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><title>old</title><link>https://o</link><pubDate>Mon, 05 Feb 2001 10:00:00 GMT</pubDate></item><item><title>undated</title><link>https://u</link></item></rss>"
    rows = spark.createDataFrame([("q", 200, body), ("q", 500, body), ("q", 200, None)], "keyword string, status int, body string")
    got = {(r["url"], r["title"]) for r in discover.feed_results(rows, Config()).collect()}
    assert {t for _, t in got} == {"A & B", "undated"} and ("https://u", "undated") in got
    (url,) = [u for u, t in got if t == "A & B"]
    assert url.startswith("https://a.example/news/123456"[:20])


def test_feed_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>t</title><link>https://l</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><title>o</title><link>https://o</link><pubDate>Mon, 05 Feb 2001 10:00:00 GMT</pubDate></item></channel></rss>")
    items = tables.read_feed(spark, str(tmp_path / "feed.xml"))
    assert [r["url"] for r in collect.rss_in_range(items, Config()).collect()] == ["https://l"]


def test_page_helpers(spark):
    one = spark.createDataFrame([('<head><time datetime="2024-02-05T10:00">x</time></head><title> T </title><p>Text</p>',)], "html string")
    r = one.select(web.page_date(one.html).alias("d"), web.page_title(one.html).alias("t")).first()
    assert r["d"].startswith("2024-02-05") and r["t"] == "T"
    url = one.select(web.search_url("https://s/?q={q}&p={page}", one.html.substr(1, 0), one.html.substr(1, 0).cast("string")).alias("u")).first()["u"]
    assert url == "https://s/?q=&p="


def test_semantic_fallback_admits_what_words_miss(spark):
    config = replace(Config(), semantic=True, semantic_threshold=0.9, primary=("rice price",), places=("karo",))
    rows = [(1, "rice price in karo", "t", 10), (2, "cost of grain in karo", "t", 10), (3, "cost of grain elsewhere", "t", 10), (4, "football in karo", "t", 10)]
    articles = spark.createDataFrame(rows, "article_id int, full_text string, title string, char_length long")
    embed = lambda texts: [[1.0, 0.0] if "rice" in t or "grain" in t else [0.0, 1.0] for t in texts]
    ids = lambda **how: {r[0] for r in collect.finished(articles, config, **how).select("article_id").collect()}
    assert ids() == {1} and ids(embed=embed) == {1, 2}


def test_sample_of_a_large_table_needs_few_rows(spark):
    rows = spark.range(20_000).selectExpr("id as article_id", "if(id % 10 = 0, 'A', 'B') as label")
    got = validation.stratified_sample(rows, 50, 10).collect()
    lots = sorted(((r["label"], validation_lot(r["article_id"]), r["article_id"]) for r in rows.collect()), key=lambda x: x[1:])
    a, b = ([i for k, _, i in lots if k == name] for name in "AB")
    assert {r["article_id"] for r in got} == set(a[:13]) | set(b[:37]) and len(got) == 50


def validation_lot(key):
    import hashlib

    return hashlib.md5(f"42:{key}".encode()).hexdigest()

"""Raw outputs, caches, quality control, stub extraction, sources and the runner."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.operators import extraction, qc
from tidewater.plans import runner
from tidewater.sources import crawl, tables

CONFIG = Config()
FULL = {"reasoning_chain": {s: "a" for s in qc.STEPS}, "label": "PRICEREPORT", "sentiment_score": 1.0001, "confidence": 0.5, "commodities": ["x"], "supply_location": None, "is_forward_looking": True, "rationale": "r"}


def repaired(spark, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(qc.repaired(F.col("raw")).alias("p")).first()["p"]


def test_plain_fenced_and_listed(spark):
    body = json.dumps(FULL)
    for raw in (body, f"```json\n{body}\n```", f"```\n{body}\n```", f"[{body}]"):
        p = repaired(spark, raw)
        assert (p["label"], p["sentiment_score"], p["confidence"], p["commodities"]) == ("PRICEREPORT", 1.0, 0.5, ["x"])


def test_misplaced_missing_and_broken(spark):
    p = repaired(spark, json.dumps({"reasoning_chain": {"step1_commodities": "a", "label": "DEMANDSHOCK"}, "confidence": 0.25}))
    assert p["label"] == "DEMANDSHOCK" and p["reasoning_chain"]["step1_commodities"] == "a" and p["reasoning_chain"]["step2_geography"] == "auto-filled"
    assert repaired(spark, '{"label": null, "reasoning_chain": {"label": "DEMANDSHOCK"}}')["label"] is None
    assert repaired(spark, "[]")["label"] == "IRRELEVANT"
    assert repaired(spark, "not json {") is None and repaired(spark, None) is None


def test_quality_control(spark):
    rows = [(1, "PRICEREPORT", 0.2, 0.599, "success"), (2, "PRICEREPORT", 1.0001, 0.6, "success"), (3, "PRICEREPORT", -2.0, None, "success"), (4, "NEWS", None, 1.2, "success"), (5, "PRICEREPORT", 0.0, 0.9, "failed"), (6, None, 0.0, 0.9, "success")]
    df = spark.createDataFrame(rows, "article_id int, label string, sentiment_score double, confidence double, extraction_status string")
    got = {r[0]: tuple(r)[1:4] for r in qc.quality_controlled(df, CONFIG).collect()}
    assert got == {1: ("IRRELEVANT", 0.2, 0.599), 2: ("PRICEREPORT", 1.0, 0.6), 3: ("PRICEREPORT", -1.0, None), 4: ("IRRELEVANT", None, 1.0), 6: ("IRRELEVANT", 0.0, 0.9)}


def test_joins_keep_clashing_columns(spark):
    a = spark.createDataFrame([(1, "s"), (2, "t")], "article_id int, source string")
    e = spark.createDataFrame([(1, "x", None)], "article_id int, source string, label string")
    assert qc.joined(a, e).columns == ["article_id", "source", "source_ext", "label"]
    assert {r["article_id"]: r["label"] for r in qc.for_exploration(a, e.drop("source")).collect()} == {1: "UNKNOWN", 2: "NO_EXTRACTION"}


def test_stub_extraction_and_cache(spark, tmp_path):
    articles = spark.createDataFrame([("a", "t", "2024-01-01", "s", "text"), ("b", None, None, None, None)], "article_id string, title string, published_date string, source string, full_text string")
    first = extraction.extract(articles, None, extraction.Stub(), CONFIG)
    assert {r["status"] for r in first.collect()} == {"success"}
    tables.append_to_cache(first, str(tmp_path / "cache"))
    cache = tables.read_cache(spark, str(tmp_path / "cache"))
    assert {r["article_id"]: r["extraction"]["label"] in CONFIG.labels for r in cache.collect()} == {"a": True, "b": True}
    assert extraction.extract(articles, cache, extraction.Stub(), CONFIG).count() == 0
    assert tables.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_unknown_template():
    with pytest.raises(ValueError):
        extraction.build_prompt("other", CONFIG)


def test_retries_wait_longer_each_time():
    waits, answers = [], iter([RuntimeError("x"), extraction.RateLimited(), ("not json", 1, 1), ("{}", 1, 1)])

    def client(prompt):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert extraction._attempt(client, "p", 5, 10, extraction._is_json, waits.append) == ("{}", 1, 1)
    assert waits == [10, 30, 10]


def test_fetch():
    waits, answers = [], iter([(429, ""), (200, "ok")])
    assert crawl.fetch(lambda u: next(answers), "u", 3, 2, waits.append) == (200, "ok")
    assert waits == [4]

    def broken(url):
        raise OSError("no network")

    assert crawl.fetch(broken, "u", 2, 2, waits.append) == (0, "no network")


def test_pages_source(spark):
    spark.dataSource.register(crawl.PagesSource)
    rows = spark.read.format("tidewater_pages").option("urls", json.dumps(["http://a/1", "http://a/2", "http://b/1"])).option("client", "tests.client:get").option("interval", "0").load().collect()
    assert sorted((r["url"], r["status"]) for r in rows) == [("http://a/1", 200), ("http://a/2", 200), ("http://b/1", 200)]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"article_id": "1"}\nbroken\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), strict=True).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("P1", 1.5), ("P2", None)], tables.TARGET)
    tables.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), tables.TARGET).collect())) == [("P1", 1.5), ("P2", None)]


def test_runner():
    calls = []
    stages = {n: (lambda n=n: calls.append(n)) for n in ("a", "b", "c")}
    runner.run(stages, start="b")
    assert calls == ["b", "c"]
    runner.run(stages, only=["c", "a"])
    assert calls == ["b", "c", "c", "a"]
    with pytest.raises(runner.UnknownStage):
        runner.run(stages, only=["z"])
    with pytest.raises(runner.StageFailed):
        runner.run({"x": lambda: 1 / 0})


def test_config(tmp_path):
    (tmp_path / "c").write_text("decay: 0.5\nanchor: 2020-01-01  # day\n")
    assert Config.read(str(tmp_path / "c")).decay == 0.5
    with pytest.raises(KeyError):
        Config.of({"nothing": 1})


def test_prompts_become_strings_in_parts(spark):
    """However many rows come in a batch, a worker has called for no more than a part when the first rows leave."""
    asked = []

    class Asked(extraction.Stub):
        def __call__(self, prompt):
            asked.append(prompt)
            return "{}", len(prompt), 0

    n = 3 * extraction.PART + 1
    frame = spark.createDataFrame([], "article_id long, prompt string")
    prompts = SimpleNamespace(schema=frame.schema, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: run))
    batch = pa.RecordBatch.from_pydict({"article_id": list(range(n)), "prompt": ["x" * (i % 7) for i in range(n)]})
    out = extraction.call(prompts, Asked(), CONFIG)(iter([batch]))
    parts = [next(out)]
    assert len(asked) == extraction.PART
    rows = [r for part in [*parts, *out] for r in part.to_pylist()]
    assert [(r["article_id"], r["raw"], r["tokens_prompt"], r["status"]) for r in rows] == [(i, "{}", i % 7, "success") for i in range(n)]

"""The 14-day table, validation metrics, series statistics, export and the stream, by hand."""

from __future__ import annotations

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.config import LABELS, Config
from tidewater.operators import explore, export, periods, series, validation
from tidewater.streaming.biweekly import biweekly_counts

CONFIG = replace(Config(), anchor=dt.date(2021, 1, 1), date_end=dt.date(2021, 4, 30))
KIND = "published_date date, label string, type_ab string, sentiment_score double, confidence double"


def day(n):
    return dt.date(2021, 1, 1) + dt.timedelta(n)


def features(spark, rows):
    return {r["period_id"]: r for r in periods.biweekly_features(spark.createDataFrame(rows, KIND), CONFIG).collect()}


def test_index_by_hand(spark):
    got = features(spark, [(day(0), "SUPPLYSHOCK", "A", -1.0, 0.8), (day(2), "SUPPLYSHOCK", "A", 1.0, 1.0)])["BW0001"]
    w = 0.8 * math.exp(-0.6)
    assert got["sentiment_all"] == pytest.approx((1 - w) / (1 + w)) and got["sentiment_all"] == pytest.approx(0.38981, abs=1e-5)
    assert got["has_extreme_news"] == 1 and got["max_neg_sentiment"] == -1 and got["prop_negative_articles"] == 0.5


def test_empty_low_gaps_and_edges(spark):
    rows = [(day(-1), "PRICEREPORT", "N/A", 1.0, 1.0), (None, "PRICEREPORT", "N/A", 1.0, 1.0), (day(500), "PRICEREPORT", "N/A", 1.0, 1.0)]
    rows += [(day(14), "SUPPLYSHOCK", "A", 0.5, 1.0)]  # one relevant article: low confidence, value kept
    rows += [(day(28), "PRICEREPORT", "N/A", 0.25, 1.0)] * 4  # normal, without a supply shock: takes the value before
    rows += [(day(42), "PRICEREPORT", "N/A", 0.25, 0.0)] * 2  # no weight at all
    got = features(spark, rows)
    assert len(got) == 9
    assert got["BW0001"]["is_imputed"] and got["BW0001"]["sentiment_all"] == 0 and got["BW0001"]["no_relevant_news_t"] == 1
    assert got["BW0002"]["low_confidence_period"] and got["BW0002"]["sentiment_supply"] == 0.5
    assert got["BW0003"]["coverage_flag"] == "NORMAL" and got["BW0003"]["sentiment_supply"] == 0.5 and got["BW0003"]["sentiment_demand"] == 0
    assert got["BW0004"]["sentiment_all"] == 0 and got["BW0004"]["coverage_flag"] == "SPARSE"


def test_no_articles_and_order(spark):
    assert all(r["is_imputed"] and r["sentiment_all"] == 0 for r in features(spark, []).values())
    draw = random.Random(4)
    rows = [(day(draw.randrange(120)), draw.choice(LABELS), draw.choice(["A", "B", "N/A"]), draw.uniform(-1, 1), draw.random()) for _ in range(300)]
    one = features(spark, rows)
    draw.shuffle(rows)
    two = features(spark, rows)
    for k, r in one.items():
        for c in r.asDict():
            assert r[c] == (pytest.approx(two[k][c]) if isinstance(r[c], float) else two[k][c])
        assert all(-1 <= r[f"sentiment_{i}"] <= 1 for i in periods.INDICES)


def test_agreement(spark):
    notes = [(i, r, label) for i, row in enumerate([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", None)]) for r, label in zip(("x", "y"), row, strict=True)]
    df = validation.tidy_labels(spark.createDataFrame(notes, "article_id int, rater string, label string"), ("A", "B"))
    assert validation.cohen_kappa(df).first()["kappa"] == pytest.approx((0.75 - 0.5) / 0.5)
    assert validation.krippendorff_alpha(df).first()["alpha"] == pytest.approx(1 - 2 / ((64 - 9 - 25) / 7), abs=1e-6)
    assert {r[0]: r[1] for r in validation.majority(df).collect()} == {0: "A", 1: "CONFLICT", 2: "B", 3: "B", 4: "A"}


def test_stratified_sample(spark):
    rows = spark.range(1000).selectExpr("id as article_id", "case when id < 700 then 'a' when id < 980 then 'b' when id < 995 then 'c' end as label")
    got = validation.stratified_sample(rows, 100, 10)
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert got.count() == 100 and counts["c"] >= 10 and counts["a"] > counts["b"] > counts["c"]
    assert validation.stratified_sample(rows, 5000, 10).count() == 1000
    assert [r[0] for r in got.collect()] == [r[0] for r in validation.stratified_sample(rows.repartition(3), 100, 10).collect()]


def test_f1(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "CONFLICT")], "article_id int, label string")
    guess = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "A")], "article_id int, label string")
    got = {r["label"]: r for r in validation.class_metrics(validation.confusion(truth, guess, ("A", "B", "C"))).collect()}
    assert got["A"]["precision"] == 1 and got["A"]["recall"] == 0.5 and got["C"]["f1"] == 0
    assert got["B"]["macro_f1"] == pytest.approx(2 / 3 * 2 / 3, abs=1e-6)


def test_stationarity():
    draw = np.random.default_rng(1)
    noise, walk = draw.normal(size=300), np.cumsum(draw.normal(size=300))
    assert series.stationarity(noise)["is_stationary"] is True
    assert series.stationarity(walk)["is_stationary"] is False and series.stationarity(walk)["action_needed"] == "first_difference"
    assert series.stationarity(noise[:9])["action_needed"] == "insufficient_data"
    assert series.stationarity(np.ones(30))["is_stationary"] in (None, False)
    assert series.made_stationary(walk)[1] == "first_difference"


@pytest.mark.parametrize(("tau", "p"), [(-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)])
def test_published_critical_values(tau, p):
    """The asymptotic critical values of the test with a constant."""
    assert abs(series.adf_pvalue(tau) - p) < 0.003


def test_tests_reject_as_often_as_they_should():
    draw = np.random.default_rng(11)
    walks, noise = np.cumsum(draw.normal(size=(300, 150)), axis=1), draw.normal(size=(300, 150))
    assert 0.02 <= np.mean([series.adf(y)[1] < 0.05 for y in walks]) <= 0.10
    assert np.mean([series.adf(y)[1] < 0.05 for y in noise]) > 0.95
    assert 0.01 <= np.mean([series.kpss(y)[1] < 0.05 for y in noise]) <= 0.10
    assert np.mean([series.kpss(y)[1] < 0.05 for y in walks]) > 0.7


def test_granger_and_order():
    draw = np.random.default_rng(2)
    x = draw.normal(size=200)
    y = 0.8 * np.roll(x, 1) + 0.3 * draw.normal(size=200)
    led, blind = series.granger(y[1:], x[1:], 4, 0.05), series.granger(x[1:], y[1:], 4, 0.001)
    assert all(r["significant"] for r in led) and not blind[0]["significant"]
    assert series.var_order(y[1:], x[1:], 4) == 1 and series.var_order(y[:5], x[:5], 4) == 2
    assert series.granger(y[:8], x[:8], 4, 0.05) == []


@pytest.mark.parametrize("value, d1, d2, p", [(4.965, 1, 10, 0.05), (3.326, 5, 10, 0.05), (2.711, 5, 20, 0.05), (1.0, 10, 10, 0.5), (0.0, 1, 1, 1.0)])
def test_f_distribution(value, d1, d2, p):
    assert series.f_tail(value, d1, d2) == pytest.approx(p, abs=2e-4)


def test_report_needs_periods(spark):
    few = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "t int, y double, x double")
    with pytest.raises(series.NotEnoughData):
        series.granger_report(few, "t", "y", ["x"])


def test_cross_correlation(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=60)
    rows = [(i, float(x[i - 2]), float(x[i])) for i in range(2, 60)]
    got = {r["lag"]: r["correlation"] for r in series.cross_correlation(spark.createDataFrame(rows, "t int, y double, x double"), "y", "x", "t").collect()}
    assert got[2] == pytest.approx(1) and max(abs(v) for k, v in got.items() if k != 2) < 0.6
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)], "t int, y double, x double")
    assert {r["correlation"] for r in series.cross_correlation(flat, "y", "x", "t").collect()} == {0.0}


def test_missing_months(spark):
    rows = spark.createDataFrame([("a", dt.date(2021, 1, 5)), ("a", dt.date(2021, 4, 1)), ("b", dt.date(2021, 2, 1)), ("b", None)], "k string, d date")
    assert sorted(r[0] for r in explore.missing_months(rows, "d").collect()) == ["2021-03"]
    assert sorted(map(tuple, explore.missing_months(rows, "d", "k").collect())) == [("a", "2021-02"), ("a", "2021-03")]
    assert explore.missing_months(rows.where("false"), "d").count() == 0


def test_checklist(spark):
    table = periods.biweekly_features(spark.createDataFrame([], KIND), CONFIG)
    good = {r["check_name"]: r["passed"] for r in export.checklist(table, True, True).collect()}
    assert good["all_passed"] and good["sentiment_typeA_range"]
    bad = {r["check_name"]: r["passed"] for r in export.checklist(table.withColumn("sentiment_typeA", F.lit(2.0)), True, None).collect()}
    assert not bad["all_passed"] and not bad["sentiment_typeA_range"] and not bad["validation_report_exist"]
    assert export.final_features(table.withColumn("sentiment_typeA", F.lit(2.0))).agg(F.max("sentiment_typeA")).first()[0] == 1.0


def test_stream_equals_table(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = biweekly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), CONFIG)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("biweekly").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        key = lambda df: sorted((r[0], r[1], r[2], round(r[3], 6)) for r in df.collect())
        assert key(spark.table("biweekly")) == key(biweekly_counts(events, CONFIG))
    finally:
        query.stop()

"""The news stages from found pages to exported features, each reading what the one before it wrote.

    python -m tidewater.plans.news --data FOLDER [--only STAGE ..] [--from STAGE] [--no-llm]

Below FOLDER: found/ (JSON lines with url, title, full_text, published, source), inflation/ (CSV with
period_id, vf_inflation) and, if there are any, annotations/RATER/ (CSV). Every folder may be on any
file system that Spark knows.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.operators import collect, dedup, explore, export, extraction, lineage, periods, qc, series, typeab, validation
from tidewater.plans import runner
from tidewater.sources import tables

FOUND = "url string, title string, full_text string, published string, source string, source_keyword string, source_name string"
REJECTED = "url string, source string, published_date string, rejection_reason string, title string"
DECIDED = "article_id string, type_ab string, ab_confidence double, temporal_signal string"


def stages(
    spark: SparkSession, data: str, config: Config, extractor: extraction.Extractor | None, raters: tuple[str, ...] = (), sample: int = 200, ask: Callable[[float], bool] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None
) -> dict[str, Callable[[], object]]:
    """The stages by name. Without an extractor only cached extractions count and rules alone decide A or B.

    `ask` is asked about the estimated cost before paid calls; `embed` serves the semantic fallback.
    """
    wave = max(1, config.flush_every * spark.sparkContext.defaultParallelism)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{data}/{name}")

    def collected() -> dict:
        """What was found before, accepted or rejected, is not routed again; of a URL found twice the first row counts."""
        found = tables.read_jsonl(spark, f"{data}/found", FOUND, missing_ok=True).withColumn("_at", F.monotonically_increasing_id())
        found = collect.first_seen(found, "url", "_at").drop("_at")
        old = tables.read_jsonl(spark, f"{data}/articles", missing_ok=True)
        refused = tables.read_jsonl(spark, f"{data}/rejected", REJECTED, missing_ok=True)
        counted = Observation("collected")
        fresh = collect.not_done(found, collect.all_urls(old, refused), "url")
        routed = lineage.keep(collect.route(fresh, config).observe(counted, F.count(F.lit(1)).alias("routed"), F.count(F.when(F.col("disposition") == "accepted", 1)).alias("accepted"), F.count(F.when(F.col("disposition") == "out_of_range", 1)).alias("out_of_range")))
        tables.write_jsonl(collect.not_done(collect.accepted(routed, config), old, "article_id"), f"{data}/articles", append=True)
        tables.write_jsonl(collect.rejected(routed), f"{data}/rejected", append=True)
        return counted.get

    def preprocessed() -> None:
        raw = tables.read_jsonl(spark, f"{data}/articles", missing_ok=True).withColumn("pos", F.monotonically_increasing_id())
        tables.write_parquet(raw, f"{data}/positioned")
        longest = collect.keep_longest(collect.cleaned(read("positioned"), config))
        tables.write_parquet(collect.finished(dedup.deduplicated(longest, config.near_duplicate), config, embed), f"{data}/clean")
        tables.write_report(explore.monthly(read("clean"), "published_date", config.low_coverage), f"{data}/reports/months")
        tables.write_report(explore.coverage_report(read("clean"), "published_date", config), f"{data}/reports/coverage")

    def prompts() -> None:
        rows = [(k, v) for k, v in extraction.TEMPLATES.items()] + [("schema", qc.PAYLOAD)]
        tables.write_report(spark.createDataFrame(rows, "name string, body string"), f"{data}/prompts")

    def extracted() -> None:
        """Paid calls are saved wave by wave: a failed job loses one wave, and a new one goes on behind it."""
        if extractor is None:
            return
        cache = tables.read_cache(spark, f"{data}/cache")
        todo = lineage.keep(collect.not_done(read("clean"), qc.repaired_cache(cache), "article_id"))
        if not todo.count():
            return
        extraction.agreed(explore.estimated_cost(todo, "full_text", 900, 300, config.price_in, config.price_out).first()["cost"], ask)
        tables.append_in_waves((extraction.extract(part, None, extractor, config) for part in extraction.waves(todo, "article_id", wave)), f"{data}/cache")

    def parsed() -> None:
        cache = tables.read_cache(spark, f"{data}/cache")
        flat = cache.select("article_id", "extraction.*", "model", "tokens_prompt", "tokens_completion", F.col("status").alias("extraction_status"))
        rows = qc.quality_controlled(qc.joined(read("clean"), flat), config)
        tables.write_parquet(qc.pruned(rows, qc.CLEAN), f"{data}/extractions")
        tables.write_report(explore.label_distribution(read("extractions"), config.labels), f"{data}/reports/labels")

    def validated() -> None:
        rows = read("extractions")
        if not tables.exists(spark, f"{data}/validation/sample"):  # a sheet that annotators may have is not drawn again
            tables.write_annotation_sheet(validation.annotation_sheet(validation.stratified_sample(rows, sample, sample // 10)), tables.annotation_guide(spark), f"{data}/validation")
        if raters:
            notes = validation.tidy_labels(tables.read_annotations(spark, {r: f"{data}/annotations/{r}" for r in raters}), config.labels)
            tables.write_report(validation.krippendorff_alpha(notes), f"{data}/reports/alpha")
            tables.write_report(validation.cohen_kappa(notes), f"{data}/reports/kappa")
            tables.write_report(validation.class_metrics(validation.confusion(validation.majority(notes), rows, config.labels)), f"{data}/reports/f1")

    def classified() -> None:
        rows = read("extractions")
        decided = None
        if extractor is not None:
            open_ = typeab.classify(rows, config).where("ab_method = 'fallback'")
            done = tables.read_jsonl(spark, f"{data}/typeab_progress", DECIDED, missing_ok=True)
            todo = lineage.keep(collect.not_done(open_, done, "article_id"))
            tables.append_in_waves((extraction.decide_typeab(part, extractor, config) for part in extraction.waves(todo, "article_id", wave)), f"{data}/typeab_progress")
            decided = tables.read_jsonl(spark, f"{data}/typeab_progress", DECIDED, missing_ok=True).dropDuplicates(["article_id"])
        tables.write_parquet(typeab.classify(rows, config, decided), f"{data}/typeab")
        tables.remove(spark, f"{data}/typeab_progress")
        tables.write_report(typeab.guards(read("typeab"), config), f"{data}/reports/typeab")

    def aggregated() -> None:
        tables.write_parquet(periods.biweekly_features(read("typeab"), config), f"{data}/features")
        tables.write_csv(read("features").orderBy("period_id"), f"{data}/features_csv")
        tables.write_report(periods.coverage_totals(read("features")), f"{data}/reports/periods")

    def tested() -> None:
        target = tables.read_csv(spark, f"{data}/inflation", tables.TARGET)
        report = series.granger_report(read("features").join(target, "period_id"), "period_id", "vf_inflation", list(series.PAIRS), config.max_lag, config.alpha)
        tables.write_parquet(report, f"{data}/granger")
        tables.write_report(series.interpretation(read("granger")), f"{data}/reports/granger")

    def exported() -> None:
        has = {k: tables.exists(spark, f"{data}/{k}") for k in ("granger", "reports/alpha")}
        tables.write_csv(export.final_features(read("features")), f"{data}/export")
        tables.write_report(export.checklist(export.final_features(read("features")), has["granger"], True if has["reports/alpha"] else None), f"{data}/reports/checklist")

    return dict(zip(runner.NAMES, (collected, preprocessed, prompts, extracted, parsed, validated, classified, aggregated, tested, exported), strict=True))


def main(argv: list[str] | None = None) -> None:
    own = argparse.ArgumentParser(add_help=False)
    own.add_argument("--data", required=True)
    own.add_argument("--config", help="settings file, flat or in sections")
    own.add_argument("--yes", action="store_true", help="agree to the estimated cost")
    own.add_argument("--skip-env", action="store_true", help="do without a key of the service")
    own.add_argument("--raters", nargs="*", default=[])
    known, rest = own.parse_known_args(argv)
    args = runner.arguments(rest)
    config = Config.read(known.config) if known.config else Config()
    for line in config.summary():
        runner.log.info(line)
    if not (args.no_llm or known.skip_env or config.model == "stub"):
        extraction.service_key(config.provider, os.environ)
    ask = None if known.yes else lambda cost: input(f"Estimated cost {cost:.4f}. Go on? (y/n) ").strip().lower() == "y"
    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    done = runner.run(stages(spark, known.data, config, None if args.no_llm else extraction.Stub(), tuple(known.raters), ask=ask), args.only, args.start)
    print(json.dumps({d.name: round(d.seconds, 1) for d in done}))


if __name__ == "__main__":
    main()

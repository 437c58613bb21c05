"""Model-produced extractions behind an interface, with a deterministic stub that needs no network."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.config import Config
from tidewater.operators import qc

TEMPLATES = {
    "main": (
        "You label one news article on food prices in the region. Work through five steps before you answer:\n"
        "1 which goods it is about; 2 where, and whether that lies in the region; 3 what happened; 4 when; 5 what it means for prices.\n"
        "Labels, exactly one of {labels}:\n"
        "SUPPLYSHOCK: a physical change of what reaches the market, as a failed or a record harvest, a blocked road, a large release of stocks.\n"
        "DEMANDSHOCK: a shown change of what buyers take, as mass purchases or a new large programme; a festive season alone is none.\n"
        "PRICEREPORT: prices or official statistics without a physical cause.\n"
        "IRRELEVANT: elsewhere, subsidised sales, plans and speeches, or goods named in passing.\n"
        "A cause outranks a price: a price report with a broken bridge is a SUPPLYSHOCK.\n"
        "sentiment_score from -1 to 1, confidence from 0 to 1.\n\n"
        "Title: {title}\nDate: {date}\nSource: {source}\nText:\n{text}\n\n"
        "Answer with one JSON object: reasoning_chain (step1_commodities, step2_geography, step3_event_type, step4_temporal, step5_sentiment), "
        "label, sentiment_score, confidence, commodities, supply_location, is_forward_looking, rationale of at most 1000 characters."
    ),
    "typeab": (
        "Does the article look ahead (A: a threat, a forecast, a warning) or back (B: what has happened and its effects)?\n"
        "Title: {title}\nText:\n{text}\n\nAnswer with one JSON object: type_ab (A or B), ab_confidence from 0 to 1, temporal_signal."
    ),
}


#: Prompts that are Python strings at once.
PART = 256


class RateLimited(RuntimeError):
    """The service asks to wait."""


class Extractor(Protocol):
    model: str

    def __call__(self, prompt: str) -> tuple[str, int, int]:
        """(raw output, prompt tokens, completion tokens)"""
        ...


@dataclass(frozen=True)
class Stub:
    """Answers that depend on the prompt alone."""

    model: str = "stub"
    labels: tuple[str, ...] = ("SUPPLYSHOCK", "DEMANDSHOCK", "PRICEREPORT", "IRRELEVANT")

    def __call__(self, prompt: str) -> tuple[str, int, int]:
        lot = int(hashlib.sha256(prompt.encode()).hexdigest()[:12], 16)
        if "type_ab" in prompt:
            answer = {"type_ab": "AB"[lot % 2], "ab_confidence": 0.5 + lot % 50 / 100, "temporal_signal": "stub"}
        else:
            chain = {s: "stub" for s in qc.STEPS}
            answer = {"reasoning_chain": chain, "label": self.labels[lot % len(self.labels)], "sentiment_score": lot % 201 / 100 - 1, "confidence": lot % 101 / 100, "commodities": [], "supply_location": None, "is_forward_looking": lot % 3 == 0, "rationale": "stub"}
        return json.dumps(answer), len(prompt) // 4, 60


@dataclass(frozen=True)
class Silent:
    """A service that never has an answer."""

    model: str = "silent"

    def __call__(self, prompt: str) -> tuple[str, int, int]:
        return "", 0, 0


def build_prompt(kind: str, config: Config) -> Column:
    """The filled template; an unknown kind is an error."""
    if kind not in TEMPLATES:
        raise ValueError(f"unknown template: {kind}")
    text = F.lit(TEMPLATES[kind].replace("{labels}", ", ".join(config.labels)))
    for name, column in (("title", "title"), ("date", "published_date"), ("source", "source"), ("text", "full_text")):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return text


def _attempt(extractor: Extractor, prompt: str, retries: int, delay: float, valid: Callable[[str], bool], sleep: Callable[[float], None]) -> tuple[str | None, int, int]:
    for n in range(retries):
        try:
            raw, a, b = extractor(prompt)
            if raw and valid(raw):
                return raw, a, b
            wait = delay
        except RateLimited:
            wait = delay * (n + 2)
        except Exception:  # noqa: BLE001 - a service may raise anything; the article is marked as failed
            wait = delay * (n + 1)
        if n < retries - 1:
            sleep(wait)
    return None, 0, 0


def _is_json(raw: str) -> bool:
    body = raw.split("```json")[1].split("```")[0] if "```json" in raw else raw.split("```")[1] if "```" in raw else raw
    try:
        json.loads(body.strip())
    except ValueError:
        return False
    return True


class MissingKey(RuntimeError):
    """No usable key for the service."""


class Declined(RuntimeError):
    """The estimated cost was not agreed to."""


def service_key(provider: str, environment: Mapping[str, str], skip: bool = False) -> str | None:
    """The provider's key from the environment; with `skip` None if there is none. Placeholders don't count."""
    key = environment.get(f"{provider.upper()}_API_KEY", "")
    if key and not key.startswith("sk-...") and "your" not in key.lower():
        return key
    if skip:
        return None
    raise MissingKey(f"{provider.upper()}_API_KEY is missing or a placeholder")


def agreed(cost: float, ask: Callable[[float], bool] | None) -> float:
    """cost, if there is nobody to ask or the answer is yes."""
    if ask is not None and not ask(cost):
        raise Declined(f"estimated cost {cost:.4f}")
    return cost


def waves(rows: DataFrame, key: str, size: int, most: int = 1000) -> Iterator[DataFrame]:
    """rows in parts of about `size` each, or in `most` larger ones, by a hash of the key; together they are all rows."""
    count = rows.count()
    parts = min(most, max(1, -(-count // max(size, 1))))
    for k in range(parts if count else 0):
        yield rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)


def call(prompts: DataFrame, extractor: Extractor, config: Config, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(article_id, raw, tokens_prompt, tokens_completion, status) of prompts(article_id, prompt).

    Each task keeps `concurrency` calls in flight; a failed article keeps its row. Prompts become Python
    strings PART at a time, so that a worker's memory doesn't follow its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(config.concurrency) as pool:
            for batch in batches:
                for low in range(0, len(batch), PART):
                    part = batch.slice(low, PART)
                    done = list(pool.map(lambda p: _attempt(extractor, p, config.max_retries, config.retry_delay, _is_json, sleep), part.column("prompt").to_pylist()))
                    raw, before, after = ([d[i] for d in done] for i in range(3))
                    status = ["success" if d[0] else "failed" for d in done]
                    yield pa.RecordBatch.from_arrays([part.column("article_id"), pa.array(raw, pa.string()), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(status)], names=["article_id", "raw", "tokens_prompt", "tokens_completion", "status"])
                batch = part = None

    kind = prompts.schema["article_id"].dataType.simpleString()
    return prompts.select("article_id", "prompt").mapInArrow(run, f"article_id {kind}, raw string, tokens_prompt long, tokens_completion long, status string")


def extract(articles: DataFrame, cache: DataFrame | None, extractor: Extractor, config: Config, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Extractions of the articles that the cache has no success for, in the cache's form."""
    if cache is not None:
        articles = articles.join(qc.repaired_cache(cache).select("article_id"), "article_id", "left_anti")
    raw = call(articles.select("article_id", build_prompt("main", config).alias("prompt")), extractor, config, sleep)
    payload = F.when(F.col("status") == "failed", qc.failure()).otherwise(F.coalesce(qc.repaired(F.col("raw")), qc.failure("no object")))
    return raw.select("article_id", payload.alias("extraction"), F.lit(extractor.model).alias("model"), "tokens_prompt", "tokens_completion", F.current_timestamp().alias("extracted_at"), "status")


def decide_typeab(articles: DataFrame, extractor: Extractor, config: Config, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(article_id, type_ab, ab_confidence, temporal_signal) of the articles that rules leave open."""
    raw = call(articles.select("article_id", build_prompt("typeab", config).alias("prompt")), extractor, config, sleep)
    v = qc.parsed(F.col("raw"))
    kind = F.try_variant_get(v, "$.type_ab", "string")
    return raw.select(
        "article_id", F.when(kind.isin("A", "B"), kind).otherwise("UNKNOWN").alias("type_ab"), qc.clamp(F.coalesce(F.try_variant_get(v, "$.ab_confidence", "double"), F.lit(0.0)), 0, 1).alias("ab_confidence"),
        F.coalesce(F.try_variant_get(v, "$.temporal_signal", "string"), F.lit("")).alias("temporal_signal"),
    )

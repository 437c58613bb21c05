"""A data source that fetches pages: one partition a domain, so that its pace is kept without locks."""

from __future__ import annotations

import importlib
import json
import re
import time
from collections import defaultdict
from urllib.parse import quote_plus, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Domain(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(None)
        self.urls = urls


def fetch(get, url: str, retries: int, backoff: float, sleep=time.sleep) -> tuple[int, str]:
    """(status, body) of get(url); waits longer after 429 and exceptions, gives up after `retries`. 0 if nothing came."""
    last = (0, "")
    for n in range(retries):
        try:
            status, body = get(url)
        except Exception as error:  # noqa: BLE001 - whatever a client raises counts as a failed attempt
            last = (0, str(error))
            sleep(backoff * (n + 1))
            continue
        last = (status, body)
        if status != 429:
            return last
        sleep(2 ** (n + 2))
    return last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        by_domain = defaultdict(list)
        for url in json.loads(self.options["urls"]):
            by_domain[urlsplit(url).netloc].append(url)
        return [_Domain(urls) for urls in by_domain.values()] or [_Domain([])]

    def read(self, partition):
        module, _, name = self.options["client"].partition(":")
        get = getattr(importlib.import_module(module), name)
        pace, retries, backoff = float(self.options.get("interval", 3)), int(self.options.get("retries", 3)), float(self.options.get("backoff", 2))
        ready = 0.0
        for url in partition.urls:
            time.sleep(max(0.0, ready - time.monotonic()))
            ready = time.monotonic() + pace
            yield (url, *fetch(get, url, retries, backoff))


class PagesSource(DataSource):
    """format("tidewater_pages") with options urls (a JSON list), client (module:function of a URL), interval, retries, backoff."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_pages"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema):
        return _Reader(dict(self.options))


HREF = re.compile(r"""<a[^>]*\shref=["']([^"'#]+)["']""", re.IGNORECASE)


class _Searches(InputPartition):
    def __init__(self, tasks: list[dict]):
        super().__init__(None)
        self.tasks = tasks


class _SearchReader(DataSourceReader):
    """Tasks of one domain go one after the other in one partition; a query ends at the first page that fails or has no link."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        by_domain = defaultdict(list)
        for task in json.loads(self.options["tasks"]):
            by_domain[urlsplit(task["template"]).netloc].append(task)
        return [_Searches(tasks) for tasks in by_domain.values()] or [_Searches([])]

    def read(self, partition):
        module, _, name = self.options["client"].partition(":")
        get = getattr(importlib.import_module(module), name)
        number = lambda key, default: float(self.options.get(key, default))
        pace, retries, backoff, pages = number("interval", 3), int(number("retries", 3)), number("backoff", 2), int(number("max_pages", 30))
        per_query, whole = number("query_seconds", 300), number("total_seconds", 600)
        began, ready = time.monotonic(), 0.0
        for task in partition.tasks:
            since = time.monotonic()
            for page in range(1, pages + 1):
                now = time.monotonic()
                if now - since > per_query or now - began > whole:
                    yield (task["source_key"], task["keyword"], page, 0, "time limit")
                    break
                time.sleep(max(0.0, ready - now))
                ready = time.monotonic() + pace
                url = task["template"].replace("{query}", quote_plus(task["keyword"])).replace("{page}", str(page))
                status, body = fetch(get, url, retries, backoff)
                yield (task["source_key"], task["keyword"], page, status, body)
                if status != 200 or not HREF.search(body or ""):
                    break


class SearchSource(DataSource):
    """format("tidewater_search") with options tasks (a JSON list of source_key, keyword, template), client, max_pages, interval, retries, backoff, query_seconds, total_seconds."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_search"

    def schema(self) -> str:
        return "source_key string, keyword string, page int, status int, body string"

    def reader(self, schema):
        return _SearchReader(dict(self.options))

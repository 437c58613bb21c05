"""Named stages in order, each timed; the first error ends the run."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

log = logging.getLogger("tidewater")

NAMES = ("collect", "preprocess", "prompts", "extract", "parse_qc", "validate", "typeab", "aggregate", "granger", "export")


class UnknownStage(ValueError):
    """A stage of that name doesn't exist."""


class StageFailed(RuntimeError):
    """A stage raised; the cause is chained."""


@dataclass(frozen=True)
class Done:
    name: str
    seconds: float
    result: object


def select(names: Sequence[str], only: Sequence[str] | None = None, start: str | None = None) -> list[str]:
    """`only` wins, in the order given; else all from `start` on."""
    for n in [*(only or []), *([start] if start else [])]:
        if n not in names:
            raise UnknownStage(n)
    if only:
        return list(only)
    return list(names[names.index(start) :]) if start else list(names)


def run(stages: dict[str, Callable[[], object]], only: Sequence[str] | None = None, start: str | None = None) -> list[Done]:
    done = []
    for name in select(list(stages), only, start):
        began = time.monotonic()
        try:
            result = stages[name]()
        except Exception as error:
            raise StageFailed(name) from error
        done.append(Done(name, time.monotonic() - began, result))
        log.info("%s took %.1f s", name, done[-1].seconds)
    return done


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Run stages of the news analytics")
    parser.add_argument("--only", nargs="+", choices=NAMES)
    parser.add_argument("--from", dest="start", choices=NAMES)
    parser.add_argument("--no-llm", action="store_true", help="rules only; open cases become N/A")
    return parser.parse_args(argv)

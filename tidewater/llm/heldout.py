"""Folds of a table, so that no document is scored by a model that was fitted on it.

A document's fold follows from its text: equal texts share one. What a document is scored by is
counted over the other folds; only a language with too few texts in a fold is counted over all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, LEAST_TEXTS = 2, 10


def fold_of(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS))


def scarce(docs: DataFrame) -> list[str]:
    """Languages of docs(lang, text) with fewer than LEAST_TEXTS distinct texts (counted by a sketch) in some fold."""
    each = [F.approx_count_distinct(F.when(fold_of() == i, F.xxhash64("text"))).alias(f"n{i}") for i in range(FOLDS)]
    counts = docs.where("lang is not null and text is not null").groupBy("lang").agg(*each)
    return sorted(r[0] for r in counts.where(F.least(*[f"n{i}" for i in range(FOLDS)]) < LEAST_TEXTS).collect())  # a row a language


def folds(docs: DataFrame, few: list[str]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(what to fit on, what to score) for each fold of docs; every row is scored in one of them."""
    for i in range(FOLDS):
        yield docs.where((fold_of() != i) | F.col("lang").isin(few)), docs.where(fold_of() == i)

"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` documents of each label 0 and 1, those of least hash.

    Ids with contradicting labels, null labels or null ids are left out; ids may have any type that is
    the same in both tables. The ids drawn are bounded by the parameter, hence small enough to
    broadcast; the documents are read once and not shuffled.
    """
    agreed = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    agreed = agreed.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("y2")).where("y = y2")
    drawn = None
    for y in (0, 1):
        own = agreed.where(F.col("y") == y).select("id", "y").orderBy(F.xxhash64("id"), "id").limit(per_class)
        drawn = own if drawn is None else drawn.union(own)
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")

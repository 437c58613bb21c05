"""Candidate pairs as tiles: blocks of classes that meet in a bucket, each pair in exactly one tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.lineage import keep


def bucket_tiles(classes: DataFrame, tile: int) -> DataFrame:
    """(low, high, class, block): the tiles of classes(class, bands), where bands lists the buckets of a class.

    Each class gets as home the smallest class of its buckets that it meets most often. Small homes,
    such as strangers that meet only in a common passage, come together by the widest bucket that any
    of their classes is in; homes and what came together are cut into blocks of about `tile` classes.
    Two blocks that share a bucket make a tile of those of their classes that share one with the other
    block; a block makes a tile with itself. So classes in a bucket of n lie in about n / tile tiles
    each, be they one family or strangers. Buckets are counted before they are joined to their
    classes, so that the planner can split a bucket of very many.
    """
    keyed = classes.select("class", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1")
    met = keep(keyed.join(buckets, "key"))
    often = met.groupBy("class", "least").agg(F.count("*").alias("n"), F.max(F.struct("n", "key")).alias("widest"))
    home = keep(often.groupBy("class").agg(F.max_by("least", F.struct("n", F.bitwise_not("least"))).alias("home"), F.max("widest").alias("widest")))
    homes = home.groupBy("home").agg(F.count("*").alias("n"), F.max("widest").alias("widest"))
    large = F.col("n") > tile // 4
    homes = homes.select("home", "n", large.alias("large"), F.when(large, F.col("home")).otherwise(F.col("widest.key")).alias("group"))
    parts = homes.groupBy("large", "group").agg(F.ceil(F.sum("n") / tile).alias("parts"))
    part = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("class")).otherwise(F.col("home"))), F.col("parts"))
    placing = homes.join(parts, ["large", "group"]).select("home", "large", "group", "parts")
    blocks = home.join(placing, "home").select("class", F.xxhash64("large", "group", part).alias("block"))
    placed = met.select("key", "class").join(blocks, "class")
    beside = placed.select("key", F.col("block").alias("other")).distinct()
    several = beside.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    across = placed.join(beside.join(several, "key"), "key").where("block <> other")
    across = across.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "block").distinct()
    within = placed.select(F.col("block").alias("low"), F.col("block").alias("high"), "class", "block").distinct()
    return within.union(across)


def roots(near: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix the first row that it is connected with."""
    label = np.arange(len(near))
    a, b = np.nonzero(near)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if (least == label).all():
            return label
        label = least

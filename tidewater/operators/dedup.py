"""Greedy near-duplicate removal by MinHash.

A pair is similar if at least `threshold` of its 64 signature values agree. At 0.85 at most 9 values
may differ, so of 12 bands of 5 or 6 values three at least are whole, and of the two halves of the bands
one holds two of them: keys of two bands of one half lose nothing, and strangers in one language, who
share many a single band, hardly meet. Pairs that share a key are verified on all 64 values, in tiles,
before anything is linked; only then do similar articles form connected components. Within a component the greedy rule runs as written (articles in order of
position; of a similar pair the longer stays, of equally long ones the earlier), and components can't
affect each other. The rule is a sequence, so a component, a family of near copies, is one task; the
task holds a few numbers for each of its articles and one signature for each distinct one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.components import connected_components
from tidewater.operators.lineage import keep
from tidewater.operators.tiles import bucket_tiles, roots

PERMUTATIONS, SHINGLE, TILE = 64, 5, 512
PIECE = 1 << 15


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), draw.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


def signatures_of(texts: list[str | None], seed: int = 42) -> np.ndarray:
    """A row of 64 minima of affine hashes over the character shingles of each lower-cased, stripped text."""
    out = np.full((len(texts), PERMUTATIONS), np.iinfo(np.uint64).max, dtype=np.uint64)
    own = [(t or "").lower().strip() for t in texts]
    a, b = _constants(seed)
    start = 0
    while start < len(own):
        end, size = start, 0
        while end < len(own) and (end == start or size + len(own[end]) < PIECE):
            size += len(own[end]) + SHINGLE
            end += 1
        # zeros behind each text stand for what a text shorter than a shingle lacks
        points = np.frombuffer("".join(t + "\0" * SHINGLE for t in own[start:end]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t in own[start:end]])
        begin = np.cumsum(lengths + SHINGLE) - lengths - SHINGLE
        value = np.zeros(len(points) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            value = value * np.uint64(1_000_003) + points[k : k + len(value)]
            value ^= value >> np.uint64(29)
        value *= np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        counts = np.maximum(lengths - SHINGLE + 1, 1)
        first = np.cumsum(counts) - counts
        value = value[np.arange(counts.sum()) + np.repeat(begin - first, counts)]
        scratch = np.empty_like(value)
        for low in range(0, len(value), PIECE):  # a longer text in pieces that stay in cache
            high = min(low + PIECE, len(value))
            part, room = value[low:high], scratch[low:high]
            rows = np.flatnonzero((first < high) & (first + counts > low))
            cuts = np.maximum(first[rows] - low, 0)
            for p in range(PERMUTATIONS):
                np.multiply(part, a[p], out=room)
                np.add(room, b[p], out=room)
                out[start + rows, p] = np.minimum(out[start + rows, p], np.minimum.reduceat(room, cuts))
        start = end
    return (out >> np.uint64(32)).astype(np.int64)


def signature(text: str, seed: int = 42) -> np.ndarray:
    return signatures_of([text], seed)[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = signatures_of(batch.column("full_text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(signs) + 1, dtype=np.int32) * PERMUTATIONS), pa.array(signs.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("char_length"), lists], names=["pos", "char_length", "signature"])


def signatures(articles: DataFrame) -> DataFrame:
    """(pos, char_length, signature) of articles(pos, full_text, char_length)."""
    base = articles.select(F.col("pos").cast("long").alias("pos"), F.coalesce("char_length", F.lit(0)).cast("long").alias("char_length"), "full_text")
    return base.mapInArrow(_sign, "pos long, char_length long, signature array<long>")


def agreement(a: Column, b: Column) -> Column:
    """Share of equal values of two signatures; 0 if their lengths differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.greatest(F.size(a), F.lit(1))
    return F.when(F.size(a) == F.size(b), same).otherwise(0.0)


def bands_for(threshold: float) -> int:
    """Bands of which one is whole if no more values differ than the threshold allows."""
    return min(PERMUTATIONS, PERMUTATIONS - math.ceil(threshold * PERMUTATIONS - 1e-9) + 1)


def keys_for(threshold: float) -> list[tuple[tuple[int, int], ...]]:
    """Keys as spans of a signature's values, of which one is whole if no more values differ than the threshold allows.

    With two bands more than bands_for three at least are whole, of which one half of the bands holds two;
    where there are not so many values, single bands.
    """
    bands = bands_for(threshold) + 2
    pairs = bands <= PERMUTATIONS
    if not pairs:
        bands = bands_for(threshold)
    edges = [PERMUTATIONS * i // bands for i in range(bands + 1)]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    if not pairs:
        return [(span,) for span in spans]
    return [*itertools.combinations(spans[: bands // 2], 2), *itertools.combinations(spans[bands // 2 :], 2)]


def greedy(sizes: np.ndarray, kind: np.ndarray, signs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of some articles, in order of position, stay. kind: the row of each in signs."""
    stays = np.ones(len(sizes), dtype=bool)
    for i in range(len(sizes)):
        if not stays[i]:
            continue
        alike = (signs == signs[kind[i]]).mean(axis=1) >= threshold
        later = np.flatnonzero(stays[i + 1 :] & alike[kind[i + 1 :]]) + i + 1
        longer = later[sizes[later] > sizes[i]]
        if len(longer):
            later = later[later < longer[0]]
            stays[i] = False
        stays[later] = False
    return stays


def _similar(threshold: float):
    """Of tiles, sorted by (low, high): (u, v), each class with the first of its tile that it is connected with."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        if not parts:
            return None
        node, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        if len(node) < 2:
            return None
        signs = np.concatenate([p[1] for p in parts])[first]
        same = np.zeros((len(node), len(node)), dtype=np.int16)
        for column in signs.T:
            same += column[:, None] == column[None, :]
        label = roots(same >= threshold * PERMUTATIONS - 1e-9)
        hung = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[label[hung]])], names=["u", "v"]) if len(hung) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            low, high, node = (batch.column(c).to_numpy() for c in ("low", "high", "class"))
            signs = batch.column("signature").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), PERMUTATIONS)
            new = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, [len(batch)]))
            for a, b in zip(new[:-1], new[1:], strict=True):
                if (low[a], high[a]) != tile:
                    if (out := flush(parts)) is not None:
                        yield out
                    tile, parts = (low[a], high[a]), []
                parts.append((node[a:b], signs[a:b]))
        if (out := flush(parts)) is not None:
            yield out

    return run


def near_duplicates(articles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(pos) of the articles to drop."""
    signs = keep(signatures(articles).withColumn("class", F.xxhash64("signature")))
    classes = keep(signs.groupBy("class").agg(F.first("signature").alias("signature"), F.count("*").alias("n")))
    keys = F.array(*[F.xxhash64(*[F.slice("signature", low + 1, high - low) for low, high in spans], F.lit(i)) for i, spans in enumerate(keys_for(threshold))])
    tiles = bucket_tiles(keep(classes.select("class", keys.alias("bands"))), TILE).join(classes.select("class", "signature"), "class")
    tiles = tiles.select("low", "high", "class", "block", "signature").repartition("low", "high").sortWithinPartitions("low", "high")
    groups = connected_components(tiles.mapInArrow(_similar(threshold), "u long, v long")).withColumnRenamed("node", "class")
    # components of one class with one article have nothing to drop
    grouped = classes.select("class", "n").join(groups, "class", "left").where("component is not null or n > 1").select("class", F.coalesce("component", "class").alias("component"))
    members = signs.join(grouped, "class").select("component", "pos", "char_length", "class", "signature")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        _, first, kind = np.unique(part["class"].to_numpy(), return_index=True, return_inverse=True)
        own = np.stack([part["signature"].iloc[i] for i in first])
        return part.loc[~greedy(part["char_length"].to_numpy(), kind, own, threshold), ["pos"]]

    return members.groupBy("component").applyInPandas(run, "pos long")


def deduplicated(articles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """articles without near-duplicates; run keep_longest over URLs before."""
    return articles.join(near_duplicates(articles, threshold), "pos", "left_anti")

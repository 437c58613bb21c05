"""Quality classifier: Naive Bayes support vectors.

Features are hashed n-gram indicators of a text: words, word pairs, and n-grams up to three of word
shapes (case, digits, trailing mark, length class, and whether the word repeats one of the two before
it). Each indicator is scaled by the log-count ratio of the classes; on the scaled and normalised
vectors a linear model with hinge loss is fitted by dual coordinate descent: each document has a dual
variable between 0 and the cost of its class. The fit uses at
most `per_class` labelled documents of each class (see labelled_sample); scoring covers every
document.

Defined results: null and empty texts get the score of the bias alone; a missing class among the
labels makes every document good; repeated rows are each scored; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.labelled import labelled_sample
from tidewater.llm.textscan import WHITE, Joined, Words, as_column, gram_hashes, list_array, mix64, pieces

BITS, PER_CLASS, C, EPOCHS, SMOOTHING = 20, 6000, 1.0, 20, 1.0

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 mark; other scripts as lower
_KIND[128:] = 2
for _c in range(33, 127):
    _KIND[_c] = 1 if 65 <= _c < 91 else 2 if 97 <= _c < 123 else 3 if 48 <= _c < 58 else 4


def shapes(joined: Joined, words: Words) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _KIND[joined.data]
    value = np.zeros(len(words.start), dtype=np.uint64)
    for k in (1, 2, 3, 4):
        count = np.zeros(len(kind) + 1, dtype=np.int32)
        np.cumsum(kind == k, out=count[1:])
        value = value * np.uint64(4) + np.minimum(count[words.end] - count[words.start], 3).astype(np.uint64)
    last = joined.data[words.end - 1]
    value = value * np.uint64(256) + np.where(kind[words.end - 1] == 4, last, 0).astype(np.uint64)
    size = np.minimum((words.end - words.start) // 4, 7)
    value = value * np.uint64(8) + size.astype(np.uint64)
    for back in (1, 2):
        same = np.zeros(len(value), dtype=np.uint64)
        if len(value) > back:
            same[back:] = (words.hash[back:] == words.hash[:-back]) & (words.doc[back:] == words.doc[:-back])
        value = value * np.uint64(2) + same
    return mix64(value + np.uint64(1))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row << BITS | feature, ascending and distinct; number of features of each row)."""
    joined = Joined(texts)
    words = Words(joined, WHITE)
    keys = []
    for salt, (hashes, n) in enumerate([(words.hash, 1), (words.hash, 2), *((shapes(joined, words), k) for k in (1, 2, 3))]):
        grams = gram_hashes(hashes, n, salt + 1)
        doc = words.doc[: len(grams)]
        own = doc == words.doc[n - 1 :] if n > 1 else slice(None)
        keys.append((doc[own].astype(np.int64) << BITS) | (grams[own] >> np.uint64(64 - BITS)).astype(np.int64))
    flat = np.sort(np.concatenate(keys))
    if len(flat):
        flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
    return flat, np.bincount(flat >> BITS, minlength=len(texts)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray  # of the indicator, the ratio multiplied in
    square: np.ndarray  # squared ratio, for the length of a vector
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for low, high in pieces(texts):
            flat, counts = features(texts.slice(low, high - low))
            ids, row = flat & ((1 << BITS) - 1), flat >> BITS
            size = np.sqrt(np.bincount(row, self.square[ids], minlength=high - low))
            out[low:high] += np.bincount(row, self.weight[ids], minlength=high - low) / np.maximum(size, 1e-12)
        return out


def log_count_ratio(ids: list[np.ndarray], y: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    counts = np.zeros((2, 1 << BITS))
    for own, label in zip(ids, y, strict=True):
        counts[int(label > 0), own] += 1
    p = counts + smoothing
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    ratio[counts.sum(axis=0) == 0] = 0
    return ratio


def fit(ids: list[np.ndarray], y: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 3, tolerance: float = 0.01) -> Model:
    """y: +1 or -1. Dual coordinate descent on the hinge loss, each class with the same total cost."""
    ratio = log_count_ratio(ids, y)
    vectors = []
    for own in ids:
        x = ratio[own]
        vectors.append(x / max(np.sqrt(x @ x), 1e-12))
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * c
    norm = np.array([x @ x for x in vectors]) + 1.0
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(y)):
            own, x = ids[i], vectors[i]
            gradient = y[i] * (w[own] @ x + bias) - 1
            # of the gradient only what the box leaves room for
            open_ = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost[i] else gradient
            if open_ == 0:
                continue
            worst = max(worst, abs(open_))
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[own] += step * x
            bias += step
        if worst < tolerance:
            break
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(bias))


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_column(batch, "text")
        for low, high in pieces(texts):
            flat, counts = features(texts.slice(low, high - low))
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([as_column(part, "doc_id"), as_column(part, "y"), list_array((flat & ((1 << BITS) - 1)).astype(np.int32), counts, pa.int32())], names=["doc_id", "y", "ids"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, label, per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(_collect_features, f"doc_id {kind}, y int, ids array<int>").toArrow().sort_by([("doc_id", "ascending")])
    lists = table["ids"].combine_chunks()
    y = np.where(table["y"].to_numpy() > 0, 1, -1) if table.num_rows else np.zeros(0)
    if not len(y) or abs(y.sum()) == len(y):
        zero = np.zeros(1 << BITS, dtype=np.float32)
        return Model(zero, zero, 1.0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], y)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, keep) of every document; keep if the score is not below 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.value.score(texts))

    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0).alias("keep"))

"""Toxicity by a factorization machine over hashed terms.

Terms are runs of letters and digits of the lower-cased text, and the first `STEM` bytes of longer
ones, so that inflected and compound words share a term; they are hashed to 2**18 indicators. The
machine adds to the linear weights of the terms a low-rank weight for each pair, so that two terms
harmless by themselves can be toxic together. It is fitted by AdaGrad on the logistic loss, on at most
`per_class` labelled documents of each class (see labelled_sample).

The noise of rare words in long texts is kept out by grafting: weights start at zero, and in each of at
most `ROUNDS` rounds those terms get weights for which the loss of what is fitted so far has a
significant slope, either in the linear weight (`LINEAR_Z` standard errors) or in the weight of a pair
(`PAIR_Z`, as more are tested). For the latter all terms are dealt into `PROBES` groups at random, and
each term is tested against the signed sum of each group's terms: a pair of terms is seen whether or
not either tells anything alone, if enough documents have both. The odds are corrected to the classes'
shares among all labels.

Defined results: null and empty texts get the bias alone and are not toxic; a missing class among
the labels makes nothing toxic; repeated rows are each scored; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.labelled import labelled_sample
from tidewater.llm.textscan import NOT_ALNUM, Joined, Words, as_column, list_array, mix64, pieces

BITS, PER_CLASS, FACTORS, EPOCHS, RATE, L2 = 18, 6000, 8, 12, 0.1, 1e-4
#: Rounds of grafting, groups of terms, standard errors; EXTRA is added to each variance, as a few documents tell little.
ROUNDS, PROBES, LINEAR_Z, PAIR_Z, EXTRA = 4, 64, 5.0, 7.0, 0.15
STEM = 5
THRESHOLD = 0.2


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row << BITS | term, ascending and distinct; number of terms of each row)."""
    joined = Joined(pc.utf8_lower(texts))
    words = Words(joined, NOT_ALNUM)
    long = words.end - words.start > STEM
    start, stem = words.start[long], np.full(int(long.sum()), 1, dtype=np.uint64)
    for k in range(STEM):
        stem = stem << np.uint64(8) | joined.data[start + k].astype(np.uint64)
    doc, value = np.concatenate((words.doc, words.doc[long])), np.concatenate((words.hash, mix64(stem)))
    flat = np.sort((doc.astype(np.int64) << BITS) | (value >> np.uint64(64 - BITS)).astype(np.int64))
    if len(flat):
        flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
    return flat, np.bincount(flat >> BITS, minlength=len(texts)).astype(np.int64)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    active: np.ndarray

    def logit(self, ids: np.ndarray) -> float:
        v = self.factors[ids]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[ids].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text."""
        out = np.full(len(texts), self.bias)
        for low, high in pieces(texts):
            flat, _ = terms(texts.slice(low, high - low))
            flat = flat[self.active[flat & ((1 << BITS) - 1)]]
            ids, row = flat & ((1 << BITS) - 1), flat >> BITS
            own = np.bincount(row, self.linear[ids], minlength=high - low).astype(np.float64)
            v = self.factors[ids].astype(np.float64)
            for k in range(v.shape[1]):
                own += 0.5 * (np.bincount(row, v[:, k], minlength=high - low) ** 2 - np.bincount(row, v[:, k] ** 2, minlength=high - low))
            out[low:high] += own
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


class _Slopes:
    """Tests of the loss's slope in the weight of every term, and of its pairs with groups of terms."""

    def __init__(self, ids: list[np.ndarray], draw: np.random.Generator):
        self.row = np.repeat(np.arange(len(ids)), [len(own) for own in ids])
        self.flat = np.concatenate(ids).astype(np.int64)
        self.sign = np.where(draw.random(1 << BITS) < 0.5, -1.0, 1.0)
        self.group = draw.integers(0, PROBES, 1 << BITS)
        own = self.group[self.flat]
        self.order = np.argsort(own, kind="stable")
        self.bounds = np.searchsorted(own[self.order], np.arange(PROBES + 1))

    def _by_term(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, each[self.row], minlength=1 << BITS)

    def significant(self, slope: np.ndarray, variance: np.ndarray) -> np.ndarray:
        """slope, variance: of each document's loss in its score."""
        alone = self._by_term(slope)
        found = np.abs(alone) > LINEAR_Z * np.sqrt(self._by_term(variance) + EXTRA)
        for k in range(PROBES):
            own = self.order[self.bounds[k] : self.bounds[k + 1]]
            beside = np.bincount(self.row[own], self.sign[self.flat[own]], minlength=len(slope))
            paired, error = self._by_term(slope * beside), np.sqrt(self._by_term(variance * beside**2) + EXTRA)
            mine = self.group == k  # a term is no pair with itself
            paired[mine] -= self.sign[mine] * alone[mine]
            found |= np.abs(paired) > PAIR_Z * error
        return found


def fit(ids: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 5) -> Model:
    """y: +1 or -1, both of them there."""
    draw = np.random.default_rng(seed)
    share = (y > 0).mean()
    model = Model(float(np.log(share / (1 - share))), np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS)), np.zeros(1 << BITS, dtype=bool))
    slopes = _Slopes(ids, draw)
    kept = [own[:0] for own in ids]
    past_bias, past_linear, past_factors = 1e-6, np.full(1 << BITS, 1e-6), np.full((1 << BITS, FACTORS), 1e-6)
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-np.clip([model.logit(own) for own in kept], -50, 50)))
        variance = np.maximum(chance * (1 - chance), 1e-3)
        new = slopes.significant(chance - (y > 0), variance) & ~model.active
        if not new.any():
            break
        model.active |= new
        model.factors[new] = draw.normal(0, 0.05, (int(new.sum()), FACTORS))
        kept = [own[model.active[own]] for own in ids]
        for i in np.concatenate([draw.permutation(len(y)) for _ in range(epochs)]):
            own = kept[i]
            v = model.factors[own]
            s = v.sum(axis=0)
            logit = model.bias + model.linear[own].sum() + 0.5 * (s @ s - (v * v).sum())
            slope = -y[i] / (1 + np.exp(np.clip(y[i] * logit, -50, 50)))
            past_bias += slope * slope
            model.bias -= rate * slope / np.sqrt(past_bias)
            if not len(own):
                continue
            g = slope + l2 * model.linear[own]
            past_linear[own] += g * g
            model.linear[own] -= rate * g / np.sqrt(past_linear[own])
            g = slope * (s - v) + l2 * v
            past_factors[own] += g * g
            model.factors[own] -= rate * g / np.sqrt(past_factors[own])
    return model


def _collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_column(batch, "text")
        for low, high in pieces(texts):
            flat, counts = terms(texts.slice(low, high - low))
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([as_column(part, "doc_id"), as_column(part, "y"), list_array((flat & ((1 << BITS) - 1)).astype(np.int32), counts, pa.int32())], names=["doc_id", "y", "ids"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, label, per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(_collect_terms, f"doc_id {kind}, y int, ids array<int>").toArrow().sort_by([("doc_id", "ascending")])
    y = np.where(table["y"].to_numpy() > 0, 1, -1) if table.num_rows else np.zeros(0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(-50.0, np.zeros(1 << BITS), np.zeros((1 << BITS, 1)), np.zeros(1 << BITS, dtype=bool))
    lists = table["ids"].combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    model = fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], y)
    shares = {int(r[0]): r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    model.bias += np.log(shares[1] / shares[0]) - np.log((y > 0).sum() / (y < 0).sum())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) of every document; toxic from a probability of `threshold` on."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, per_class))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(texts))

    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).alias("toxic"))

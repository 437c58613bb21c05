"""Interpolated Kneser-Ney character models, counted by Spark and stored in sorted hash arrays.

A symbol takes 12 bits, so the n-grams of an order up to 5 fit a 64-bit code whose low bits hold the
last symbol; `mix64` of the code is its hash, without collisions. Characters below U+0BB8 are a symbol
each, those above two, their leading and their last ten bits, so that no two are taken for one. One array of sorted hashes for each
order serves all languages of a model; next to it lies a matrix with the log-probability of that
n-gram in each language, already interpolated with all lower orders, also where a language never saw
it. A position costs one lookup; only n-grams that no text of the training corpus had walk down to
lower orders, by way of stored back-off weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textscan import as_column, give_back, mix64, pieces, runs
from tidewater.operators.lineage import discard, stored

BITS = 12
ORDER = 5
COUNT_BYTES = 1 << 20
MERGE_AT = 1 << 20


#: Code points from WIDE on take two symbols, the first of them from HIGH on.
WIDE, HIGH = 3000, 3002


def _table(of: Callable[[str], int | None]) -> np.ndarray:
    """First symbol of each code point: 0 only for NUL, 1 for what `of` gives None, else 2 .. 4089."""
    table = np.ones(0x110000, dtype=np.uint16)
    for cp in range(0x110000):
        if (value := of(chr(cp))) is not None:
            table[cp] = 2 + value if value < WIDE else HIGH + (value >> 10)
    table[0] = 0
    return table


_CACHE: dict[str, np.ndarray] = {}


def symbols(kind: str) -> np.ndarray:
    """`letters`: letters each for itself, all else one blank. `raw`: blanks alike, digits alike, all else itself."""
    if kind not in _CACHE:
        if kind == "letters":
            _CACHE[kind] = _table(lambda c: ord(c) if c.isalpha() else None)
        elif kind == "raw":
            _CACHE[kind] = _table(lambda c: None if c.isspace() else 48 if c.isdecimal() else ord(c))
        else:
            raise ValueError(f"unknown symbols: {kind}")
    return _CACHE[kind]


def codes_of(texts: pa.Array, kind: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each symbol, and the text it belongs to; nulls are as empty."""
    texts = pc.fill_null(texts, "")
    strings = (pc.utf8_lower(texts) if kind == "letters" else texts).to_pylist()
    gap = "\0" * (order - 1)
    points = np.frombuffer((gap + gap.join(strings) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(strings), dtype=np.int32), np.fromiter(map(len, strings), np.int64, len(strings)) + (order - 1))
    ids = symbols(kind)[points]
    doc = np.concatenate((np.zeros(order - 1, np.int32), doc))
    wide = ids >= HIGH
    if wide.any():
        size = 1 + wide.astype(np.int64)
        ids, doc = np.repeat(ids, size), np.repeat(doc, size)
        ids[(np.cumsum(size) - 1)[wide]] = 2 + (points[wide] & 1023)
    if kind == "letters":  # runs of blanks count once; so do blanks at the edges of a text, as none
        blank = ids == 1
        drop = np.zeros(len(ids), dtype=bool)
        drop[1:] = blank[1:] & (ids[:-1] <= 1)
        ids, doc = ids[~drop], doc[~drop]
    wide = ids.astype(np.uint64)
    code = wide.copy()
    for k in range(1, order):
        code[k:] |= wide[:-k] << np.uint64(BITS * k)
    real = ids != 0
    return code[real], doc[real]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    values, lengths = runs(codes)
    starts = np.cumsum(lengths) - lengths
    return values, np.add.reduceat(counts, starts) if len(counts) else counts


def _count(kind: str, order: int):
    def rows(lang: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        pending: dict[str, int] = {}
        for batch in batches:
            langs = as_column(batch, "lang")
            for lang in pc.unique(langs).to_pylist():
                texts = as_column(batch, "text").filter(pc.equal(langs, lang))
                for low, high in pieces(texts, COUNT_BYTES):
                    code, _ = codes_of(texts.slice(low, high - low), kind, order)
                    if not len(code):
                        continue
                    held.setdefault(lang, []).append(runs(np.sort(code)))
                    pending[lang] = pending.get(lang, 0) + len(held[lang][-1][0])
                    if sum(pending.values()) > MERGE_AT:
                        for k in list(held):
                            held[k] = [_merge(held[k])]
                            pending[k] = len(held[k][0][0])
                        if sum(pending.values()) > MERGE_AT // 2:  # partial counts; Spark adds them up
                            for k in list(held):
                                yield rows(k, *held.pop(k)[0])
                            pending.clear()
        for lang in list(held):
            yield rows(lang, *_merge(held.pop(lang)))
        give_back()

    return run


def count_grams(docs: DataFrame, kind: str, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each n-gram of the highest order occurs, over all texts of docs(lang, text)."""
    partial = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_count(kind, order), "lang string, code long, n long")
    return partial.groupBy("lang", "code").agg(F.sum("n").alias("n"))


@contextmanager
def counted(docs: DataFrame, kind: str, order: int) -> Iterator[tuple[DataFrame, dict[str, int]]]:
    """(counts as of count_grams, how many n-grams each language has); the counts lie in the shared folder meanwhile."""
    counts, path = stored(count_grams(docs, kind, order), "grams")
    try:
        yield counts, {r[0]: r[1] for r in counts.groupBy("lang").count().collect()}  # a row a language
    finally:
        discard(docs.sparkSession, path)


def groups_of(sizes: dict[str, int], limit: int, joint: bool) -> list[list[str]]:
    """Languages in groups whose models stay within `limit` bytes; joint: the models of a group share their arrays.

    Nothing has been fetched when a language that is too large alone is refused.
    """
    out: list[list[str]] = []
    for lang in sorted(sizes):
        need = lambda group: sum(sizes[k] for k in group) * (14 + 4 * (len(group) if joint else 1)) * 3 // 2  # noqa: E731 - hashes, directory, logarithms; half as much for lower orders
        if need([lang]) > limit:
            raise ValueError(f"the model of {lang} would take about {need([lang]) >> 20} MB, too large to broadcast; use a lower order")
        if out and need([*out[-1], lang]) <= limit:
            out[-1].append(lang)
        else:
            out.append([lang])
    return out


class SortedHash:
    """Positions of hashes in a sorted array, by a directory over their leading bits."""

    def __init__(self, codes: np.ndarray):
        keys = mix64(codes)
        self.order = np.argsort(keys)
        keys = keys[self.order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(keys, edges).astype(np.int32)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each code, and whether it is there."""
        wanted = mix64(codes)
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        here = self.keys[at]
        late = np.flatnonzero(here < wanted)
        while len(late):
            at[late] += 1
            now = self.keys[at[late]]
            here[late] = now
            late = late[now < wanted[late]]
        found = here == wanted
        found &= at < len(self.keys) - 1
        return at, found


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """What to take off the counts 0, 1, 2 and from 3 on."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    if not modified:
        return np.array([0, y, y, y])
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.array([0, min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)])


class KneserNey:
    """Models of some languages over one set of sorted hash arrays."""

    def __init__(self, langs: list[str], lang: np.ndarray, codes: np.ndarray, counts: np.ndarray, order: int = ORDER, modified: bool = False, alphabet: int | None = None):
        """lang: index into langs of each row of (codes, counts), the n-grams of the highest order; alphabet: symbols there are, if more than in these."""
        self.langs, self.order, width = langs, order, len(langs)
        grams: dict[int, np.ndarray] = {order: np.unique(codes)}
        seen = np.zeros((len(grams[order]), width))
        np.add.at(seen, (np.searchsorted(grams[order], codes), lang), counts)
        tables = {order: seen}
        for n in range(order - 1, 0, -1):
            grams[n], back = np.unique(grams[n + 1] & np.uint64((1 << BITS * n) - 1), return_inverse=True)
            tables[n] = np.stack([np.bincount(back, tables[n + 1][:, k] > 0, len(grams[n])) for k in range(width)], axis=1)
        self.index: dict[int, SortedHash] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.contexts: dict[int, SortedHash] = {}
        self.backoff: dict[int, np.ndarray] = {}
        lower = np.full((1, width), 1 / ((len(grams[1]) if alphabet is None else alphabet) + 1))
        for n in range(1, order + 1):
            count = tables[n]
            take = np.stack([_discounts(count[:, k], modified)[np.minimum(count[:, k], 3).astype(np.int64)] for k in range(width)], axis=1)
            contexts, lengths = runs(grams[n] >> np.uint64(BITS))
            starts = np.cumsum(lengths) - lengths
            total = np.add.reduceat(count, starts) if len(starts) else count
            free = np.add.reduceat(take, starts) if len(starts) else take
            with np.errstate(divide="ignore", invalid="ignore"):
                gamma = np.where(total > 0, free / total, 1.0)
                rest = lower if n == 1 else lower[np.searchsorted(grams[n - 1], grams[n] & np.uint64((1 << BITS * (n - 1)) - 1))]
                each = np.repeat(total, lengths, axis=0)
                p = np.where(each > 0, (count - take) / np.where(each > 0, each, 1), 0.0) + np.repeat(gamma, lengths, axis=0) * rest
            if n == 1:
                self.floor = np.log(np.maximum(gamma[0] if len(gamma) else np.ones(width), 1e-9) * lower[0]).astype(np.float32)
            self.index[n] = SortedHash(grams[n])
            self.logp[n] = np.log(np.maximum(p, 1e-30)).astype(np.float32)[self.index[n].order]
            self.contexts[n] = SortedHash(contexts)
            self.backoff[n] = np.log(np.maximum(gamma, 1e-30)).astype(np.float32)[self.contexts[n].order]
            del self.index[n].order, self.contexts[n].order
            lower = p
        # cross-entropy of the corpus itself under each language's own model, and its variance a symbol
        bits = -np.log(np.maximum(lower, 1e-30))
        weight = np.maximum(seen.sum(axis=0), 1)
        self.mean = (seen * bits).sum(axis=0) / weight
        self.variance = np.maximum((seen * bits**2).sum(axis=0) / weight - self.mean**2, 0)

    def nbytes(self) -> int:
        parts = [*self.logp.values(), *self.backoff.values(), *(a for s in (*self.index.values(), *self.contexts.values()) for a in (s.keys, s.first))]
        return sum(a.nbytes for a in parts)

    def score(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log-probability of each n-gram's last symbol after the others, a column for each language."""
        n = self.order if order is None else order
        if n == 0:
            return np.repeat(self.floor[None, :], len(codes), axis=0)
        if not len(self.logp[n]):
            return np.repeat(self.floor[None, :], len(codes), axis=0)
        at, found = self.index[n].find(codes)
        if found.all():
            return self.logp[n][at]
        out = self.logp[n][np.where(found, at, 0)]
        missing = np.flatnonzero(~found)
        part = codes[missing]
        down = self.score(part & np.uint64((1 << BITS * (n - 1)) - 1), n - 1)
        if n > 1:
            context, known = self.contexts[n].find(part >> np.uint64(BITS))
            down = down + np.where(known[:, None], self.backoff[n][np.where(known, context, 0)], 0)
        out[missing] = down
        return out

    def cross_entropy(self, texts: pa.Array, kind: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: nats a symbol under each language, and how many symbols. 0 for texts without any."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for low, high in pieces(texts, limit):
            code, doc = codes_of(texts.slice(low, high - low), kind, self.order)
            if not len(code):
                continue
            logp = self.score(code)
            values, lengths = runs(doc)
            starts = np.cumsum(lengths) - lengths
            sums[low + values] = -np.add.reduceat(logp, starts, axis=0, dtype=np.float64)
            sizes[low + values] = lengths
        return sums / np.maximum(sizes, 1)[:, None], sizes

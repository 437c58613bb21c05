"""Vectorised text primitives shared by the operators that run inside Arrow batches.

Everything here works on whole texts: a batch is cut between documents, never inside one, so that
the temporaries of one piece stay within a few dozen MB whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x100000001B3
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: equal inputs, and only those, give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest asked for so far is kept while it stays small."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _powers(base, n)
        if n <= 2 * PIECE_BYTES:
            _POWERS[base] = known
    return known[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base & _MASK
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step = step * step & _MASK
        done *= 2
    return out[:n]


def give_back() -> None:
    """Memory that a finished partition no longer needs goes back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def let_go(shared) -> None:
    """A broadcast value leaves the worker's memory until the next partition asks for it: an idle worker holds no model."""
    shared.__dict__.pop("_value", None)
    give_back()


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each; a longer single text is its own range."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def as_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Joined:
    """The UTF-8 bytes of some texts, each followed by one separator byte."""

    def __init__(self, texts: pa.Array, separator: int = 10):
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets).astype(np.int64)
        self.starts = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.starts[1:])
        self.data = np.full(int(self.starts[-1]), separator, dtype=np.uint8)
        inside = np.ones(len(self.data), dtype=bool)
        inside[self.starts[1:] - 1] = False
        self.data[inside] = data[offsets[0] : offsets[-1]]
        self.n = len(lengths)


class Words:
    """Words of joined texts: start, end (exclusive), 64-bit hash and the document of each."""

    def __init__(self, joined: Joined, separators: np.ndarray):
        is_sep = separators[joined.data]
        before = np.empty_like(is_sep)
        if len(is_sep):
            before[0] = True
            before[1:] = is_sep[:-1]
        edge = np.flatnonzero(is_sep != before)
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(joined.data)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((joined.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=prefix[1:])
        value = (prefix[self.end] - prefix[self.start]) * powers(_BASE_INV, n + 1)[self.start]
        self.hash = mix64(value + (self.end - self.start).astype(np.uint64))
        self.doc = np.searchsorted(joined.starts, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=joined.n).astype(np.int64)
        self.first = np.zeros(joined.n + 1, dtype=np.int64)
        np.cumsum(self.per_doc, out=self.first[1:])


def separator_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: ASCII white space, as the class [ \t\n\v\f\r] of the SQL checks.
WHITE = separator_table(b" \t\n\x0b\x0c\r")
#: Everything of ASCII but letters and digits; the bytes of other scripts belong to words.
NOT_ALNUM = np.array([i < 128 and not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123) for i in range(256)])


def gram_hashes(word_hash: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words that start at each position; the last n-1 positions run past the end and are cut."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.full(m, 0x9E3779B97F4A7C15 * (salt + n) & _MASK, dtype=np.uint64)
    for k in range(n):
        value *= np.uint64(0x100000001B3)
        value += word_hash[k : k + m]
        if k:
            value ^= value >> np.uint64(29)
    return mix64(value)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, .., then those of the next, each `lengths` long."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values)))


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        return pa.LargeListArray.from_arrays(offsets, pa.array(flat, kind))
    return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(flat, kind))

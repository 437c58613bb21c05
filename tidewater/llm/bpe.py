"""Byte-level BPE encoding and decoding with a pair occurrence index.

The vocabulary is read from a file of ranks (base64 token and rank a line); it is never trained here.
A partition's texts are taken in pieces of about ENCODE_BYTES and split by the vocabulary's pattern
into chunks; a piece's distinct chunks that the partition has not met before are laid out as one array
of symbols, linked to their neighbours. An index maps each pair's
rank to all positions where that pair stands. A heap gives the active ranks in ascending order; all
positions of a rank are merged together, the pairs that arise on either side enter the lists of their
ranks, and positions whose pair has changed meanwhile are skipped. So each merge costs time in
proportion to its occurrences, however long the chunk. In chunks of at most SHORT_BYTES the index has
bands of ranks (from a power of two to the next): most ranks stand in few places, and a step costs much
the same for a few positions as for thousands. Of a band each chunk merges only its lowest rank, and the
rest waits for the next step, so every chunk goes through its ranks in the same order. Chunks that have
been encoded stay in a table until it holds more than TABLE_CHUNKS; it is then started anew.

Defined results: a null text has null tokens and is null again after decoding; an empty text has no
tokens; texts of any length are encoded whole; markers of special tokens are ordinary text; repeated
rows are each encoded; ids may have any type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewater.llm.textscan import as_column, give_back, list_array, pieces, ragged, runs

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ENCODE_BYTES = 1 << 19
TABLE_CHUNKS = 1 << 17
SHORT_BYTES = 64
NONE = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Tokens by rank, and the rank of each pair of tokens whose concatenation is a token."""

    tokens: list[bytes]
    pattern: str = PATTERN
    byte_ids: np.ndarray = field(init=False)
    pair_keys: np.ndarray = field(init=False)
    pair_ranks: np.ndarray = field(init=False)
    bands: np.ndarray = field(init=False)

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        return cls(tokens, pattern)

    def __post_init__(self) -> None:
        ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(1 << 62))
        self.pair_ranks = np.append(np.array(values, dtype=np.int32)[order], NONE)
        size = 1 << max(1, 2 * len(keys) - 1).bit_length()
        self._slots = np.full(size, len(keys), dtype=np.int32)
        self._bits = np.uint64(64 - (size.bit_length() - 1))
        slots = self._slot(self.pair_keys[:-1])
        pending = np.arange(len(keys), dtype=np.int32)
        while len(pending):  # open addressing, filled in rounds: one key wins each free slot
            free = self._slots[slots[pending]] == len(keys)
            self._slots[slots[pending[free]]] = pending[free]
            lost = self._slots[slots[pending]] != pending
            pending = pending[lost]
            slots[pending] = (slots[pending] + 1) & (size - 1)
        bits = np.frexp(np.arange(len(self.tokens)))[1]  # of a rank in binary
        self.bands = np.where(bits > 0, 1 << np.maximum(bits - 1, 0), 0).astype(np.int32)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._bits).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token."""
        keys = left.astype(np.int64) << 20 | right
        slot = self._slot(keys)
        at = self._slots[slot]
        end = len(self.pair_keys) - 1
        out = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)
        open_ = np.flatnonzero((self.pair_keys[at] != keys) & (at != end))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self._slots) - 1)
            at = self._slots[slot[open_]]
            hit = self.pair_keys[at] == keys[open_]
            out[open_[hit]] = self.pair_ranks[at[hit]]
            open_ = open_[~hit & (at != end)]
        return out


def merge_all(vocabulary: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of chunks that lie one after the other in data: (all tokens in a row, how many each has)."""
    n = len(data)
    token = vocabulary.byte_ids[data].astype(np.int32)
    chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    short = lengths <= SHORT_BYTES
    last = np.zeros(n, dtype=bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    first = np.zeros(n, dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    after = np.where(last, -1, np.arange(1, n + 1)).astype(np.int32)
    before = np.where(first, -1, np.arange(-1, n - 1)).astype(np.int32)
    rank = np.full(n, NONE, dtype=np.int32)
    inner = np.flatnonzero(~last).astype(np.int32)
    rank[inner] = vocabulary.ranks_of(token[inner], token[inner + 1])
    alive = np.ones(n, dtype=bool)
    lists: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def keys_of(at: np.ndarray) -> np.ndarray:
        own = rank[at]
        return np.where(short[chunk[at]], vocabulary.bands[own], own)

    def enter(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        if not len(at):
            return
        own = keys_of(at)
        order = np.argsort(own)
        at, own = at[order], own[order]
        values, counts = runs(own)
        for key, positions in zip(values.tolist(), np.split(at, np.cumsum(counts)[:-1]), strict=True):
            if key in lists:
                lists[key].append(positions)
            else:
                lists[key] = [positions]
                heapq.heappush(heap, key)

    enter(inner)
    while heap:
        key = heapq.heappop(heap)
        parts = lists.pop(key)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[rank[at] != NONE]
        at = np.sort(at[keys_of(at) == key])
        if not len(at):
            continue
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        # of a chunk only the lowest rank goes; the others of its band wait, as the pairs that arise may come first
        own, of = rank[at], chunk[at]
        heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        lowest = own == np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(at))))
        waiting, at = at[~lowest], at[lowest]
        touching = after[at[:-1]] == at[1:]
        if touching.any():  # of overlapping occurrences, as in aaa, the leftmost goes first
            index = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), index, 0))
            at = at[(index - start) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        alive[gone] = False
        rank[gone] = NONE
        token[at] = rank[at]
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        rank[at] = NONE
        left = before[at]
        changed = np.concatenate((at[linked], left[left >= 0]))
        rank[changed] = vocabulary.ranks_of(token[changed], token[after[changed]])
        enter(np.concatenate((changed, waiting)))
    return token[alive], np.bincount(chunk[alive], minlength=len(lengths)).astype(np.int64)


class Encoder:
    """Encodes texts piece by piece; chunks met before come from the table."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        raw = [c.encode("utf-8") for c in chunks]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        tokens, counts = merge_all(self.vocabulary, np.frombuffer(b"".join(raw), dtype=np.uint8), sizes)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
        self.lengths = np.concatenate((self.lengths, counts))
        self.flat = np.concatenate((self.flat, tokens))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts in a row, how many each has)."""
        if len(self.known) > TABLE_CHUNKS:
            self._clear()
        known, ids, sizes = self.known, [], []
        had = len(known)
        for text in texts:
            chunks = self.split(text) if text else []
            ids.extend(map(known.__getitem__, chunks))
            sizes.append(len(chunks))
        if len(known) > had:
            self._learn(list(known)[had:])
        at = np.array(ids, dtype=np.int64)
        lengths = self.lengths[at]
        tokens = self.flat[ragged(self.starts[at], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
        return tokens, np.diff(ends[bounds])


def decode(vocabulary: Vocabulary, tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each text from its tokens."""
    lengths = vocabulary.lengths[tokens]
    data = vocabulary.flat[ragged(vocabulary.starts[tokens], lengths)].tobytes()
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.read(path, pattern))
        give_back()
        for batch in batches:
            texts = as_column(batch, "text")
            for low, high in pieces(texts, ENCODE_BYTES):
                part = texts.slice(low, high - low)
                tokens, counts = encoder.encode(part.to_pylist())
                lists = list_array(tokens, counts, pa.int32())
                null = part.is_null()
                if part.null_count:
                    lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=null)
                yield pa.RecordBatch.from_arrays([as_column(batch, "doc_id").slice(low, high - low), lists, pa.array(counts.astype(np.int32), mask=null.to_numpy(zero_copy_only=False))], names=["doc_id", "tokens", "n_tokens"])
        del encoder
        give_back()

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(path, pattern)
        for batch in batches:
            lists = as_column(batch, "tokens")
            lists = lists.cast(pa.large_list(pa.int32())) if not pa.types.is_large_list(lists.type) else lists
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            step = 1 << 10
            for low in range(0, len(batch), step):
                part = lists.slice(low, step)
                words = decode(vocabulary, part.flatten().to_numpy(zero_copy_only=False), counts[low : low + step])
                texts = [w.decode("utf-8", "replace") for w in words]
                null = part.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([as_column(batch, "doc_id").slice(low, step), pa.array(texts, pa.string(), mask=null)], names=["doc_id", "text"])

    return run


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens) of every document. The vocabulary file must be readable on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, pattern), f"doc_id {kind}, tokens array<int>, n_tokens int")


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); bytes that are not UTF-8 become replacement characters."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(_decode(vocabulary, pattern), f"doc_id {kind}, text string")


def _both(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(path, pattern)
        give_back()
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = as_column(batch, "text")
            for low, high in pieces(texts, ENCODE_BYTES):
                part = texts.slice(low, high - low)
                strings = part.to_pylist()
                tokens, counts = encoder.encode(strings)
                digests = [None if s is None else hashlib.md5(b).hexdigest() for s, b in zip(strings, decode(vocabulary, tokens, counts), strict=True)]
                lists = list_array(tokens, counts, pa.int32())
                null = part.is_null()
                if part.null_count:
                    lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=null)
                yield pa.RecordBatch.from_arrays(
                    [as_column(batch, "doc_id").slice(low, high - low), lists, pa.array(counts.astype(np.int32), mask=null.to_numpy(zero_copy_only=False)), pa.array(digests, pa.string())],
                    names=["doc_id", "tokens", "n_tokens", "decoded_md5"],
                )
        del encoder, vocabulary
        give_back()

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, decoded_md5): tokens of every text, and the digest of what they decode to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_both(vocabulary, pattern), f"doc_id {kind}, tokens array<int>, n_tokens int, decoded_md5 string")

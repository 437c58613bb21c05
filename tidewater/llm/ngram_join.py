"""N-gram Jaccard self join: MinHash banding proposes, full n-gram sets decide.

Words are runs of non-blank characters of the lower-cased text. The set of a text holds its distinct
word n-grams, or the one shorter gram of all its words if it has fewer than n. Sets are compared as
sets of 64-bit hashes.

Flow: texts with equal sets fold into one class; each class sends its band keys through one shuffle.
Each class gets as home the smallest class of its buckets that it meets most often, small homes come
together by their widest bucket, what came together is cut into blocks of about `tile` classes, and
two blocks that share a bucket make a tile of those of their classes that share one with the other block. Every pair that meets in a bucket lies in exactly one
tile, whatever the sizes of families, buckets and corpus, and is verified there on the full sets; the
work follows the number of candidates. A tile reports how many documents each class is linked to and
which classes hang together, so that what leaves it is in proportion to its classes, not to its pairs.
Each text crosses the network once, its set once for each tile it is in.

Rows a band and bands are chosen (`shape`): as many bands as find a pair at the threshold with the
probability `recall`, and as few rows as keep pairs of a quarter of the threshold from meeting often.

Defined results: a document is a distinct pair of id and n-gram set, so repeated rows of one id are
one document and several texts under one id are documents of their own; null or empty texts have no
n-grams and match nothing; rows without an id can't be named and are left out; ids may have any type
that Spark can order; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.naming import fresh
from tidewater.llm.textscan import WHITE, Joined, Words, as_column, give_back, gram_hashes, list_array, mix64, pieces
from tidewater.operators.components import connected_components
from tidewater.operators.lineage import keep
from tidewater.operators.tiles import bucket_tiles, roots

N, THRESHOLD, RECALL, TILE = 3, 0.5, 0.999, 256
#: Similarity, as a share of the threshold, at which pairs should meet with at most the probability CHANCE.
BACKGROUND, CHANCE = 0.25, 0.1
#: Of the documents that go, what may be broadcast: some 2 million short ids.
BROADCAST_BYTES = 64 << 20
CELLS = 1 << 21


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands that finds a pair at the threshold with the probability `recall`."""
    if threshold >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def shape(threshold: float, recall: float) -> tuple[int, int]:
    """(rows a band, bands)."""
    for rows in range(1, 33):
        bands = bands_for(threshold, recall, rows)
        if 1 - (1 - (BACKGROUND * threshold) ** rows) ** bands <= CHANCE:
            break
    return rows, bands


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all sets in a row, size of each set) for pieces of the texts; sets are sorted."""
    for low, high in pieces(texts):
        joined = Joined(pc.utf8_lower(texts.slice(low, high - low)))
        words = Words(joined, WHITE)
        grams = gram_hashes(words.hash, n)
        out, sizes = [], np.zeros(joined.n, dtype=np.int64)
        for d in range(joined.n):
            a, b = words.first[d], words.first[d + 1]
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                own = gram_hashes(words.hash[a:b], int(b - a))
            else:
                continue
            out.append(own)
            sizes[d] = len(own)
        yield low, np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def signatures(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """Band keys, one row for each set; the sets must not be empty."""
    starts = np.cumsum(sizes) - sizes
    draw = np.random.default_rng(seed)
    keys = np.empty((len(sizes), bands), dtype=np.uint64)
    scratch = np.empty_like(grams)
    for b in range(bands):
        key = np.full(len(sizes), b + 1, dtype=np.uint64)
        for _ in range(rows):
            a, c = (np.uint64(x) for x in draw.integers(0, 1 << 64, 2, dtype=np.uint64))
            np.multiply(grams, a | np.uint64(1), out=scratch)
            np.add(scratch, c, out=scratch)
            key = mix64(key * np.uint64(0x100000001B3) + np.minimum.reduceat(scratch, starts))
        keys[:, b] = key
    return keys


def _class_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    once = np.add.reduceat(mix64(grams), starts)
    twice = np.bitwise_xor.reduceat(mix64(grams + np.uint64(0x9E3779B97F4A7C15)), starts)
    return mix64(once ^ mix64(twice + sizes.astype(np.uint64)))


def _sign(n: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = as_column(batch, "doc_id"), as_column(batch, "h")
            for low, grams, sizes in gram_sets(as_column(batch, "text"), n):
                own = np.flatnonzero(sizes)
                key, counts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                flat = np.zeros(0, np.int64)
                if len(own):
                    key[own] = _class_keys(grams, sizes[own]).view(np.int64)
                    counts[own] = bands
                    flat = signatures(grams, sizes[own], bands, rows, seed).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, len(sizes)), hashes.slice(low, len(sizes)), pa.array(key, mask=sizes == 0), list_array(flat, counts, pa.int64())],
                    names=["doc_id", "h", "class", "bands"],
                )
        give_back()

    return run


def _sets(n: int):
    """grams for the text of each row; rows of one class lie one after the other, so each text is cut once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            others = [c for c in batch.schema.names if c != "text"]
            node = as_column(batch, "class").to_numpy()
            new = np.concatenate(([True], node[1:] != node[:-1]))
            run_of, first = np.cumsum(new) - 1, np.flatnonzero(new)
            texts = as_column(batch, "text").take(pa.array(first))
            for low, grams, sizes in gram_sets(texts, n):
                offsets = np.concatenate(([0], np.cumsum(sizes * 8))).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(grams)])
                start, end = np.searchsorted(run_of, [low, low + len(sizes)])
                for at in range(start, end, 256):
                    part = batch.slice(at, min(256, end - at))
                    mine = blobs.take(pa.array(run_of[at : at + len(part)] - low))
                    yield pa.RecordBatch.from_arrays([*(as_column(part, c) for c in others), mine], names=[*others, "grams"])
        give_back()

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    m = len(sets)
    if m == 2:
        both = np.sort(np.concatenate(sets))
        shared = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column)
    shared = (often > 1)[column]
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    out = np.zeros((m, m), dtype=np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    step = max(1, CELLS // m)
    for low in range(0, width, step):
        a, b = np.searchsorted(column, [low, low + step])
        dense = np.zeros((m, min(step, width - low)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def _tile_links(sets: list[np.ndarray], blocks: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Which pairs of the tile are linked; symmetric."""
    shared = overlaps(sets)
    sizes = np.array([len(s) for s in sets])
    near = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(near, False)
    if across:
        near &= blocks[:, None] != blocks[None, :]
    return near


def _verify(threshold: float):
    """Of each tile: (u, null, documents it is linked to) and (u, v, null), the smallest class it hangs together with.

    Batches are sorted by (low, high); a tile may go on in the next batch.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[2]: r for r in rows}.values())
        if len(rows) < 2:
            return None
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in rows]
        near = _tile_links(sets, np.array([r[3] for r in rows]), rows[0][0] != rows[0][1], threshold)
        own = np.flatnonzero(near.any(axis=1))
        if not len(own):
            return None
        near = near[np.ix_(own, own)]
        node, size = np.array([rows[i][2] for i in own]), np.array([rows[i][4] for i in own])
        label = roots(near)
        hung = np.flatnonzero(label != np.arange(len(own)))
        links = near @ size
        none = np.concatenate((np.ones(len(own), bool), np.zeros(len(hung), bool)))
        u, v = np.concatenate((node, node[hung])), np.concatenate((node, node[label[hung]]))
        n = np.concatenate((links, np.zeros(len(hung), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=none), pa.array(n, mask=~none)], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            columns = [as_column(batch, c).to_pylist() for c in ("low", "high", "class", "block", "m", "grams")]
            for row in zip(*columns, strict=True):
                if row[:2] != tile:
                    if len(rows) > 1 and (out := flush(rows)) is not None:
                        yield out
                    tile, rows = row[:2], []
                rows.append(row)
        if len(rows) > 1 and (out := flush(rows)) is not None:
            yield out
        rows = []
        give_back()

    return run


def _named(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")


def signed(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> DataFrame:
    """(doc_id, h, class, bands) of every row with an id; h tells texts of one id apart; class is null without words."""
    rows, bands = shape(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keep(_named(docs).mapInArrow(_sign(n, bands, rows, seed), f"doc_id {kind}, h long, class long, bands array<long>"))


def folded(signs: DataFrame) -> DataFrame:
    """(class, row, bands, m): the first document of each class by id, band keys, and how many documents it has."""
    worded = signs.where("class is not null")
    first = worded.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("bands").alias("bands"))
    sizes = worded.select("class", "doc_id").distinct().groupBy("class").agg(F.count("*").alias("m"))
    return first.join(sizes, "class")


def verified(docs: DataFrame, classes: DataFrame, n: int = N, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(u, null, documents linked) for each class in each tile and (u, v, null) for classes that hang together."""
    work = bucket_tiles(classes, tile).join(classes.select("class", "m", "row.doc_id", "row.h"), "class")
    sets = _named(docs).join(work, ["doc_id", "h"]).select("low", "high", "class", "block", "m", "text")
    sets = sets.mapInArrow(_sets(n), "low long, high long, class long, block long, m long, grams binary")
    tiles = sets.repartition("low", "high").sortWithinPartitions("low", "high")
    return keep(tiles.mapInArrow(_verify(threshold), "u long, v long, n long"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) of every document with an id.

    Documents are linked if their n-gram sets have a Jaccard similarity of at least the threshold.
    n_links counts the other documents it is linked to, n_copies those of them with an equal set;
    class_id is the smallest id among the documents it is connected with, be it through others.
    """
    signs = signed(docs, n, threshold, recall)
    classes = keep(folded(signs))
    found = verified(docs, classes, n, threshold, tile)
    links = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("near"))
    groups = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "class")
    each = classes.select("class", "m", "row.doc_id").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = each.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    each = each.join(least, "component").join(links, "class", "left").select("class", "class_id", (F.col("m") - 1).alias("n_copies"), (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    entries = signs.groupBy("class", "doc_id").agg(F.lit(1).alias("one")).drop("one")
    none = entries.where("class is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return entries.join(each, "class").select("doc_id", "class_id", "n_copies", "n_links").union(none)


def small_or_not(fates: DataFrame, key: str) -> DataFrame:
    """fates to broadcast if they are known to take at most BROADCAST_BYTES; beyond that the join shuffles, with the same result."""
    size = fates.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 24)).first()[0] or 0
    return F.broadcast(fates) if size <= BROADCAST_BYTES else fates


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """docs without the copies: of each group of documents linked by such pairs the smallest id stays.

    Of rows with equal ids and texts one stays. Rows without an id, and texts without words, all stay.
    The columns are those of docs, whatever their names.
    """
    signs = signed(docs, n, threshold, recall)
    classes = keep(folded(signs))
    found = verified(docs, classes, n, threshold, tile)
    groups = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "class")
    first = classes.select("class", "row").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = first.join(first.groupBy("component").agg(F.min("row").alias("first")), "component").select("class", "first")
    own, digest, key, key2, fate = fresh(docs.columns, "own_id", "own_digest", "key_id", "key_digest", "fate")
    rows = signs.where("class is not null").groupBy("class", "doc_id", "h").agg(F.count("*").alias("n"))
    rows = rows.join(first, "class").withColumn("goes", F.struct("doc_id", "h") != F.col("first")).where("goes or n > 1")
    fates = keep(rows.select(F.col("doc_id").alias(key), F.col("h").alias(key2), F.when(F.col("goes"), "goes").otherwise("repeated").alias(fate)))
    repeated = fates.where(F.col(fate) == "repeated").limit(1).count()
    fates = small_or_not(fates, key)
    worded = F.expr("coalesce(doc_id is not null and text is not null and text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]', false)")
    marked = docs.where(worded).withColumns({own: F.col("doc_id"), digest: F.xxhash64("text")})
    marked = marked.join(fates, (F.col(own) == F.col(key)) & (F.col(digest) == F.col(key2)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.where(F.col(fate).isNull()).select(*columns).union(docs.where(~worded).select(*columns))
    if repeated:  # else their texts need not travel
        kept = kept.union(marked.where(F.col(fate) == "repeated").dropDuplicates([own, digest]).select(*columns))
    return kept


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\v\f\r]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    ELSE [array_to_string(w, ' ')] END)) AS g
  FROM words WHERE len(w) > 0),
classes AS (SELECT md5(array_to_string(g, chr(10))) AS c, min(doc_id) AS least, count(*) AS m, list(doc_id) AS ids, any_value(len(g)) AS size, g FROM grams GROUP BY g),
flat AS (SELECT c, size, unnest(g) AS gram FROM classes),
shared AS (SELECT a.c AS u, b.c AS v, count(*) AS n, any_value(a.size) AS su, any_value(b.size) AS sv FROM flat a JOIN flat b ON a.gram = b.gram AND a.c <> b.c GROUP BY a.c, b.c),
near AS (SELECT u, v FROM shared WHERE n >= 0.5 * (su + sv - n)),
linked AS (SELECT u AS c, sum(m) AS n FROM near JOIN classes ON v = c GROUP BY u),
reach AS (SELECT c, c AS r FROM classes UNION SELECT reach.c, near.v FROM reach JOIN near ON reach.r = near.u),
named AS (SELECT reach.c, min(classes.least) AS class_id FROM reach JOIN classes ON reach.r = classes.c GROUP BY reach.c)
SELECT unnest(ids) AS doc_id, class_id, CAST(m - 1 AS BIGINT) AS n_copies, CAST(m - 1 + coalesce(linked.n, 0) AS BIGINT) AS n_links
FROM classes JOIN named USING (c) LEFT JOIN linked USING (c)
UNION ALL
SELECT DISTINCT doc_id, doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM documents
WHERE doc_id IS NOT NULL AND NOT regexp_matches(coalesce(text, ''), '[^ \t\n\v\f\r]')
"""

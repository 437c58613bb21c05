"""Embedding near-duplicates by E8 lattice hashing.

Each of several tables projects the unit vectors at random onto `blocks` x 8 dimensions, shifts and
scales them, and decodes each 8 to the nearest point of the E8 lattice; the points together are the
vector's cell. A vector is a member of its own cell and probes the cells of the `probes` neighbouring
lattice points nearest to it (of 240 a block). Members and probers of a cell meet in one task, where
matrix products verify the cosine. Every vector probes, so a pair is found if either probe reaches
the other. Cells with more than `tile` members are split into blocks of members, which every prober
visits, and probers pass by in batches: no cell is cut and none is held whole.

Tables, blocks and the width of cells follow from the target `recall` at the threshold and the number of vectors
(`shape`): simulated pairs tell how often one table finds a pair at the threshold, hence how many are
needed, and how often unrelated vectors meet; of the shapes that reach the recall the one of least work
is taken. The recall holds at every size.

Equal vectors fold into one class before anything is compared. A pair that meets several times counts
where it meets first: each vector carries its own and its probed cells, from which that is told. A cell
reports the links of each class and which classes hang together, in proportion to its classes, not
to its pairs.

Defined results: null, empty, zero, wrongly sized or non-finite vectors match nothing and are classes of
their own; rows without an id are left out; repeated rows of one id are one, several vectors of one id
are several; equal vectors of different ids are linked; ids may have any type that Spark can order;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textscan import as_column, list_array, mix64
from tidewater.operators.components import connected_components
from tidewater.operators.lineage import keep

THRESHOLD, RECALL, PROBES, TILE, SEED = 0.9, 0.99, 4, 4096, 23
WIDTHS = (0.6, 0.8, 1.0)
STEP, PAIRS = 512, 1 << 18
#: What a row in a cell costs, in cosines; the most tables and blocks to look at; pairs and vectors simulated.
ROW_COST, MOST_TABLES, MOST_BLOCKS, SIMULATED = 400, 64, 3, 1000


def _neighbours() -> np.ndarray:
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


#: The 240 shortest vectors of E8.
SHORTEST = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row of 8: integers of even sum, or the same moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    value = np.full(len(points), table + 1, dtype=np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        value = mix64(value * np.uint64(0x100000001B3) + column.astype(np.uint64))
    return value.view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, width: float, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each vector in each table, probed cells: vector x table x probes)."""
    dims = unit.shape[1]
    draw = np.random.default_rng(seed)
    own, probed = np.empty((len(unit), tables), np.int64), np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        basis = np.linalg.qr(draw.normal(size=(max(dims, 8 * blocks), 8 * blocks)))[0][:dims]
        x = unit @ basis * np.sqrt(dims / (8 * blocks)) * (np.sqrt(blocks) / width) + draw.uniform(0, 1, 8 * blocks)
        points = np.concatenate([nearest_point(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        own[:, t] = _key(points, t)
        rest = x - points
        gain = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ SHORTEST.T for b in range(blocks)], axis=1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        for k in range(probes):
            block, which = best[:, k] // 240, best[:, k] % 240
            moved = points.copy()
            for b in range(blocks):
                at = np.flatnonzero(block == b)
                moved[at, 8 * b : 8 * b + 8] += SHORTEST[which[at]]
            probed[:, t, k] = _key(moved, t)
    return own, probed


def _rates(dims: int, threshold: float, probes: int, width: float, blocks: int, seed: int) -> tuple[float, float]:
    """How often one table finds a pair at the threshold, and two unrelated vectors."""
    draw = np.random.default_rng(seed + 1)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x, y = unit(draw.normal(size=(SIMULATED, dims))), unit(draw.normal(size=(SIMULATED, dims)))
    across = unit(y - (x * y).sum(axis=1, keepdims=True) * x) if dims > 1 else y * 0
    z = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * across
    hits, meets, tables = [], [], 8
    (own, probed), (own2, probed2) = (cells(v, tables, probes, width, blocks, seed) for v in (x, z))
    for t in range(tables):
        hits.append(((own[:, t] == own2[:, t]) | (own[:, t, None] == probed2[:, t]).any(axis=1) | (own2[:, t, None] == probed[:, t]).any(axis=1)).mean())
        values, counts = np.unique(own[:, t], return_counts=True)
        at = np.minimum(np.searchsorted(values, probed[:, t].ravel()), len(values) - 1)
        meets.append(((counts**2).sum() - len(x) + 2 * (counts[at] * (values[at] == probed[:, t].ravel())).sum()) / len(x) ** 2)
    return float(np.mean(hits)), float(np.mean(meets))


def shape(dims: int, threshold: float, recall: float, count: int, probes: int = PROBES, seed: int = SEED) -> tuple[int, int, float]:
    """(tables, blocks, width) of least work that find a pair at the threshold with the probability `recall` among `count` vectors."""
    best = None
    for blocks, width in itertools.product(range(1, MOST_BLOCKS + 1), WIDTHS):
        hit, meet = _rates(dims, threshold, probes, width, blocks, seed)
        tables = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-max(hit, 1e-9)))
        work = tables * ((1 + probes) * ROW_COST + count * meet)
        if tables <= MOST_TABLES and (best is None or work < best[0]):
            best = work, tables, blocks, width
    return best[1:]


def _usable(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are finite, not zero and of the right length; their values), from the list's flat buffer."""
    n = len(lists)
    values = lists.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.asarray(pc.fill_null(values, float("nan")), dtype=np.float64) if values.null_count else values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    x = flat[starts[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    assert len(sizes) == n
    return rows[good], x[good]


def _class_keys(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x + 0.0).view(np.uint32 if x.dtype == np.float32 else np.uint64).astype(np.uint64)
    value = np.full(len(x), x.shape[1], dtype=np.uint64)
    for column in bits.T:
        value = mix64(value * np.uint64(0x100000001B3) + column)
    return value.view(np.int64)


def _blobs(a: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    a = np.ascontiguousarray(a)
    width = a.nbytes // max(len(a), 1)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(a)])


def _hash(dims: int, real: type, tables: int, probes: int, width: float, blocks: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.slice(low, 2048)
                rows, x = _usable(as_column(part, "embedding"), dims)
                key, none = np.zeros(len(part), np.int64), np.ones(len(part), bool)
                x = x.astype(real)
                key[rows], none[rows] = _class_keys(x), False
                wide = x.astype(np.float64)
                own, probed = cells(wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True)), tables, probes, width, blocks, seed)
                at = np.full(len(part), -1)
                at[rows] = np.arange(len(rows))
                take = pa.array(at, mask=none)
                lists = lambda a, k: list_array(a.ravel(), np.full(len(rows), k), pa.int64()).take(take)
                yield pa.RecordBatch.from_arrays(
                    [as_column(part, "id"), pa.array(key, mask=none), _blobs(x).take(take), lists(own, tables), lists(probed, tables * probes)], names=["id", "class", "vector", "own", "probed"]
                )

    return run


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in doubles, so that the value depends on the pair alone."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _any_probe(probed: np.ndarray, own: np.ndarray, table: int) -> np.ndarray:
    return (probed[:, table] == own[:, table, None]).any(axis=1)


class _Cell:
    """Members of a cell's block, and what comes by."""

    def __init__(self, table: int, threshold: float, rows: tuple):
        self.table, self.threshold = table, threshold
        self.node, self.m, self.x, self.own, self.probed = rows
        self.unit = _unit(self.x)
        self.links = np.zeros(len(self.node), dtype=np.int64)
        self.label = np.arange(len(self.node))

    def _first(self, own: np.ndarray, probed: np.ndarray, node: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether each pair meets here first: in no earlier table, nor in this one by the other's probe."""
        own2, probed2 = self.own[v], self.probed[v]
        late = np.zeros(len(v), dtype=bool)
        for t in range(self.table):
            late |= (own[:, t] == own2[:, t]) | _any_probe(probed, own2, t) | _any_probe(probed2, own, t)
        same = own[:, self.table] == own2[:, self.table]
        return ~late & (same | ~_any_probe(probed2, own, self.table) | (node < self.node[v]))

    def meet(self, rows: tuple | None) -> pa.RecordBatch | None:
        """Links of some rows that come by (none: of the members among themselves) with the members."""
        inner = rows is None
        node, m, x, own, probed = (self.node, self.m, self.x, self.own, self.probed) if inner else rows
        unit = self.unit if inner else _unit(x)
        links = self.links if inner else np.zeros(len(node), dtype=np.int64)
        k = len(self.node)
        label = self.label if inner else np.concatenate((self.label, k + np.arange(len(node))))
        for low in range(0, len(node), STEP):
            dots = unit[low : low + STEP] @ self.unit.T
            near = dots >= self.threshold - 1e-5
            if inner:
                near &= np.arange(low, low + len(near))[:, None] > np.arange(k)[None, :]
            a, b = np.nonzero(near)
            for at in range(0, len(a), PAIRS):
                u, v = low + a[at : at + PAIRS], b[at : at + PAIRS]
                close = np.flatnonzero(dots[u - low, v] < self.threshold + 1e-5)
                if len(close):
                    sure = np.ones(len(u), dtype=bool)
                    sure[close] = _cosines(x[u[close]], self.x[v[close]]) >= self.threshold
                    u, v = u[sure], v[sure]
                label = hung(label, u if inner else k + u, v)
                fresh = self._first(own[u], probed[u], node[u], v) & (node[u] != self.node[v])
                u, v = u[fresh], v[fresh]
                np.add.at(links, u, self.m[v])
                np.add.at(self.links, v, m[u])
        self.label = label[:k]
        if inner:
            return None
        linked, off = np.flatnonzero(links), np.flatnonzero(label[k:] < k)
        both = np.concatenate((node, self.node)) if len(off) else node
        return links_and_edges(node[linked], links[linked], node[off], both[len(node) + label[k:][off]] if len(off) else node[off])

    def ended(self) -> pa.RecordBatch | None:
        linked, off = np.flatnonzero(self.links), np.flatnonzero(self.label != np.arange(len(self.label)))
        return links_and_edges(self.node[linked], self.links[linked], self.node[off], self.node[self.label[off]])


def hung(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each the least index connected so far, with the pairs (u, v) connected as well."""
    own = np.arange(len(label))
    a, b = np.concatenate((u, own)), np.concatenate((v, label))
    now = label
    while True:
        least = now.copy()
        np.minimum.at(least, a, now[b])
        np.minimum.at(least, b, now[a])
        least = least[least]
        if (least == now).all():
            return now
        now = least


def links_and_edges(node: np.ndarray, links: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch | None:
    if not len(node) and not len(u):
        return None
    none = np.concatenate((np.ones(len(node), bool), np.zeros(len(u), bool)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((node, u))), pa.array(np.concatenate((node, v)), mask=none), pa.array(np.concatenate((links, np.zeros(len(u), np.int64))), mask=~none)], names=["u", "v", "n"]
    )


def _verify(threshold: float, dims: int, real: type, tables: int, probes: int):
    """Batches sorted by (table, cell, block, kind): members come before the probers of their cell."""

    def stack(parts: list) -> tuple:
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, cell = None, [], None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = [as_column(batch, c).to_numpy(zero_copy_only=False) for c in ("table", "cell", "block", "kind")]
            flat = lambda c: as_column(batch, c).flatten().to_numpy(zero_copy_only=False)
            blob = as_column(batch, "vector")
            first, last = np.frombuffer(blob.buffers()[1], dtype=np.int32)[[blob.offset, blob.offset + n]]
            x = np.frombuffer(blob.buffers()[2], dtype=np.uint8)[first:last].view(real).reshape(n, dims)
            rows = (as_column(batch, "class").to_numpy(), as_column(batch, "m").to_numpy(), x, flat("own").reshape(n, tables), flat("probed").reshape(n, tables, probes))
            new = np.ones(n, dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
                now = tuple(int(c[a]) for c in keys[:3])
                if now != group:
                    if members:
                        cell = _Cell(group[0], threshold, stack(members))
                    if cell is not None:
                        if members:
                            cell.meet(None)
                        if (out := cell.ended()) is not None:
                            yield out
                    group, members, cell = now, [], None
                part = tuple(c[a:b] for c in rows)
                if keys[3][a] == 0:
                    members.append(part)
                    continue
                if members:
                    cell, members = _Cell(group[0], threshold, stack(members)), []
                    cell.meet(None)
                if cell is not None and (out := cell.meet(part)) is not None:
                    yield out
        if members:
            cell = _Cell(group[0], threshold, stack(members))
            cell.meet(None)
        if cell is not None and (out := cell.ended()) is not None:
            yield out

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    probes: int = PROBES,
    tables: int | None = None,
    blocks: int | None = None,
    width: float | None = None,
    tile: int = TILE,
    seed: int = SEED,
    dims: int | None = None,
) -> DataFrame:
    """(vec_id, class_id, n_copies, n_links) of every row of vectors(vec_id, embedding) with an id.

    Vectors are linked from a cosine of `threshold` on. n_links counts the others that a vector is
    linked to, n_copies the equal ones among them; class_id is the smallest id among those it is connected
    with, be it through others. `dims` is the vectors' length, the most frequent one (of equals the
    longest) if not given; `tables`, `blocks` and `width` are those of `shape` unless all are given.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    base = vectors.where("vec_id is not null").select(F.col("vec_id").alias("id"), "embedding")
    lengths = base.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().where("n > 0")
    usual = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    dims, count = dims or (usual["n"] if usual else 1), usual["count"] if usual else 0
    if tables is None or blocks is None or width is None:
        tables, blocks, width = shape(dims, threshold, recall, count, probes, seed)
    real = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    hashed = keep(base.mapInArrow(_hash(dims, real, tables, probes, width, blocks, seed), f"id {kind}, class long, vector binary, own array<long>, probed array<long>"))
    entries = keep(hashed.groupBy("class", "id").agg(F.lit(1).alias("one")).drop("one"))
    sizes = keep(entries.where("class is not null").groupBy("class").agg(F.count("*").alias("m"), F.min("id").alias("id")))
    classes = keep(hashed.join(sizes, ["class", "id"]).select("class", "m", "vector", "own", "probed"))
    members = classes.select("class", F.posexplode("own").alias("table", "cell")).withColumn("kind", F.lit(0))
    probers = classes.select("class", F.posexplode("probed").alias("at", "cell")).select("class", F.expr(f"int(at div {probes})").alias("table"), "cell", F.lit(1).alias("kind"))
    met = members.union(probers)
    inhabited = met.groupBy("table", "cell").agg(F.ceil(F.count(F.when(F.col("kind") == 0, 1)) / tile).cast("int").alias("parts"), F.count("*").alias("n"))
    inhabited = inhabited.where("parts > 0 and n > 1").drop("n")
    home = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    # a prober visits all blocks of a cell, a member its own and, as a prober, those after it
    placed = met.join(inhabited, ["table", "cell"]).withColumn("home", F.when(F.col("kind") == 0, home).otherwise(0))
    placed = placed.withColumn("block", F.explode(F.sequence("home", F.col("parts") - 1)))
    placed = placed.select("class", "table", "cell", "block", F.when((F.col("kind") == 0) & (F.col("block") == F.col("home")), 0).otherwise(1).alias("kind"))
    rows = placed.join(classes, "class").select("table", "cell", "block", "kind", "class", "m", "vector", "own", "probed")
    rows = rows.repartition("table", "cell", "block").sortWithinPartitions("table", "cell", "block", "kind")
    found = keep(rows.mapInArrow(_verify(threshold, dims, real, tables, probes), "u long, v long, n long"))
    links = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("near"))
    groups = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "class")
    each = sizes.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = each.groupBy("component").agg(F.min("id").alias("class_id"))
    each = each.join(least, "component").join(links, "class", "left")
    each = each.select("class", "class_id", (F.col("m") - 1).alias("n_copies"), (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    none = entries.where("class is null").select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return entries.join(each, "class").select(F.col("id").alias("vec_id"), "class_id", "n_copies", "n_links").union(none)


#: All pairs, with exact cosines.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)),
near AS (SELECT a.vec_id AS u, b.vec_id AS w, a.e = b.e AS same FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) >= {THRESHOLD} * a.size * b.size),
reach AS (SELECT vec_id AS c, vec_id AS r FROM v UNION SELECT reach.c, near.w FROM reach JOIN near ON reach.r = near.u),
named AS (SELECT c, min(r) AS class_id FROM reach GROUP BY c),
linked AS (SELECT u, count(*) AS n, count(*) FILTER (same) AS copies FROM near GROUP BY u)
SELECT DISTINCT e.vec_id, coalesce(class_id, e.vec_id) AS class_id, CAST(coalesce(copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM embeddings e LEFT JOIN named ON e.vec_id = named.c LEFT JOIN linked ON e.vec_id = linked.u WHERE e.vec_id IS NOT NULL
"""

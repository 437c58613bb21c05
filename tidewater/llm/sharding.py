"""Range sharding by sampled splitters.

Records are ordered by their key columns, then by id and text digest, all encoded into one binary key
that sorts as they do. A size-weighted sample (each record enters with a probability in proportion to
its bytes, by a hash of itself, so a retried task draws the same) is sorted by Spark, and the records at
its quantiles become the splitters, as many as the bytes need. Ranges that turn out overfull, through
chance or because one key is hot, are subdivided at exact positions of their own byte sums; equal
records too large together for one shard are dealt over several.

The bytes of a record are those of its text and RECORD_BYTES for the rest, so that records without a
text fill shards too. The driver holds one key for each shard, however many records there are: 1.6
million at 100 TB and the default target. They are broadcast; if they may exceed BROADCAST_BYTES an
error asks for larger shards before anything is placed.

Defined results: null keys and ids sort first; null texts count as 0 bytes; every record, also a
repeated one, is in exactly one shard; a record larger than a shard has one of its own or ends one;
key columns may have any type, those that are not numbers, strings, binaries, dates, timestamps or
booleans sort as their strings; an empty table gives no rows; a column named as the new one, in
whatever case, is refused rather than overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.naming import fresh
from tidewater.llm.textscan import as_column
from tidewater.operators.lineage import keep

KEYS = ("source",)
TARGET_BYTES = 64 << 20
OVERSAMPLE, SLACK = 64, 1.25
RECORD_BYTES = 32
BROADCAST_BYTES = 1 << 30
#: The most partitions that shards are written from; with more shards a partition holds several in order.
PARTITIONS = 1 << 14

_PLAIN = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _encoded(column: pa.Array) -> list[bytes]:
    """Bytes that sort as the values do and of which none begins another; a null is one zero byte."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return [b"\0" if v is None else b"\1" + (v.replace(b"\0", b"\0\xff") if b"\0" in v else v) + b"\0\0" for v in column.cast(pa.large_binary()).to_pylist()]
    if pa.types.is_floating(kind):
        bits = (np.asarray(pc.fill_null(column, 0), dtype=np.float64) + 0.0).view(np.uint64)
        bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    else:
        whole = column.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(kind) or pa.types.is_boolean(kind) else column.cast(pa.int64())
        bits = np.asarray(pc.fill_null(whole, 0), dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    raw = bits.astype(">u8").tobytes()
    null = np.asarray(column.is_null())
    return [b"\0" if none else b"\1" + raw[8 * i : 8 * i + 8] for i, none in enumerate(null)]


def encoded_keys(columns: list[pa.Array]) -> np.ndarray:
    """One key of bytes for each row."""
    out = np.empty(len(columns[0]), dtype=object)
    out[:] = [b"".join(row) for row in zip(*map(_encoded, columns), strict=True)]
    return out


def _key_columns(docs: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    kinds = {c: docs.schema[c].dataType for c in docs.columns}
    return [F.col(f"`{k}`") if isinstance(kinds[k], _PLAIN) else F.col(f"`{k}`").cast("string") for k in (*keys, "doc_id")] + [F.xxhash64("text")]


def _encode(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = encoded_keys([as_column(batch, f"k{i}") for i in range(width)])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), as_column(batch, "bytes")], names=["key", "bytes"])

    return run


def keyed_records(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(key, bytes) of every record."""
    columns = _key_columns(docs, keys)
    base = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)], (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("bytes"))
    return base.mapInArrow(_encode(len(columns)), "key binary, bytes long")


def _quantiles(offsets: dict[int, float], step: float, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = None
        for batch in batches:
            if not len(batch):
                continue
            if reach is None:
                reach = offsets[as_column(batch, "part")[0].as_py()]
            after = reach + np.cumsum(as_column(batch, "weight").to_numpy())
            before = np.concatenate(([reach], after[:-1]))
            reach = float(after[-1])
            cut = (np.floor(after / step) > np.floor(before / step)) & (before < step * (shards - 1))
            yield pa.RecordBatch.from_arrays([as_column(batch, "key").filter(pa.array(cut))], names=["key"])

    return run


def sample_splitters(keyed: DataFrame, shards: int, total: int, oversample: int = OVERSAMPLE, seed: int = 11) -> list[bytes]:
    """At most shards - 1 keys at the byte quantiles of a size-weighted sample of about oversample x shards records.

    The sample is sorted and cut by Spark; only the splitters reach the driver.
    """
    if shards < 2 or total <= 0:
        return []
    chance = F.least(F.lit(1.0), F.col("bytes") * F.lit(oversample * shards / total))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 52)) / float(1 << 52)
    sample = keyed.where(uniform < chance).select("key", (F.col("bytes") / chance).alias("weight"))
    placed = keep(sample.repartitionByRange("key").sortWithinPartitions("key").select("key", "weight", F.spark_partition_id().alias("part")))
    parts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("weight")).collect())  # a row a partition
    if not parts:
        return []
    ends = np.cumsum([w for _, w in parts])
    offsets = dict(zip([p for p, _ in parts], [0.0, *ends[:-1].tolist()], strict=True))
    found = placed.mapInArrow(_quantiles(offsets, float(ends[-1]) / shards, shards), "key binary")
    return sorted(set(found.toArrow()["key"].to_pylist()))


def _objects(keys: list[bytes]) -> np.ndarray:
    out = np.empty(len(keys), dtype=object)
    out[:] = keys
    return out


def _ranges(splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _objects(splitters)
        for batch in batches:
            at = np.searchsorted(own, _objects(as_column(batch, "key").to_pylist()), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return run


def cut(sizes: np.ndarray, copies: np.ndarray, target: int) -> tuple[list[int], list[int]]:
    """Of sorted distinct records: those that begin a new shard (the first only if it is dealt), and over how many shards each is dealt."""
    reach = np.concatenate(([0], np.cumsum(sizes)))
    share = np.where((sizes > target) & (copies > 1), -(-sizes // target), 1)
    dealt = np.append(np.flatnonzero(share > 1), len(sizes))
    starts, ways, i = [], [], 0
    while i < len(sizes):
        if i or share[i] > 1:
            starts.append(i)
            ways.append(int(share[i]))
        if share[i] > 1:
            i += 1
            continue
        end = int(np.searchsorted(reach, reach[i] + target, side="right")) - 1
        i = min(max(end, i + 1), int(dealt[np.searchsorted(dealt, i)]))
    return starts, ways


def _cut(target: int):
    def run(table: pa.Table) -> pa.Table:
        keys = _objects(table["key"].to_pylist())
        order = np.argsort(keys, kind="stable")
        starts, ways = cut(table["bytes"].to_numpy()[order], table["n"].to_numpy()[order], target)
        return pa.table({"key": pa.array(keys[order[starts]], pa.binary()), "ways": pa.array(ways, pa.int32())})

    return run


def plan_shards(docs: DataFrame, keys: tuple[str, ...] = KEYS, target_bytes: int = TARGET_BYTES, oversample: int = OVERSAMPLE, slack: float = SLACK) -> tuple[list[bytes], list[int]]:
    """(first key of every range but the first, number of shards each range is dealt over)."""
    spark = docs.sparkSession
    keyed = keep(keyed_records(docs, keys))
    total, longest = keyed.agg(F.sum("bytes"), F.max(F.octet_length("key"))).first()
    target = max(1, target_bytes)
    shards = max(1, -(-(total or 0) // target))
    if shards * ((longest or 0) + 64) > BROADCAST_BYTES:
        raise ValueError(f"the keys of {shards} shards may take more than {BROADCAST_BYTES >> 20} MB; ask for larger shards")
    splitters = sample_splitters(keyed, shards, total or 0, oversample)
    placed = keyed.mapInArrow(_ranges(splitters), "key binary, bytes long, range int")
    sizes = placed.groupBy("range").agg(F.sum("bytes").alias("size")).where(F.col("size") > slack * target)
    overfull = sizes.select("range").toArrow()
    if not overfull.num_rows:
        return splitters, [1] * (len(splitters) + 1)
    equal = placed.join(spark.createDataFrame(overfull), "range").groupBy("range", "key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    cuts = equal.groupBy("range").applyInArrow(_cut(target), "key binary, ways int").toArrow()
    ways = dict.fromkeys(splitters, 1) | dict(zip(cuts["key"].to_pylist(), cuts["ways"].to_pylist(), strict=True))
    merged = sorted(ways.items())
    return [k for k, _ in merged], [1, *(w for _, w in merged)]


def shard_records(docs: DataFrame, keys: tuple[str, ...] = KEYS, target_bytes: int = TARGET_BYTES, column: str = "shard", oversample: int = OVERSAMPLE, slack: float = SLACK) -> DataFrame:
    """docs with the shard of each record, every shard in one partition and sorted by key.

    Shards are numbered in key order; no shard but a single record exceeds `slack` times the target.
    """
    if fresh(docs.columns, column) != [column]:
        raise ValueError(f"there is a column {column} already")
    splitters, ways = plan_shards(docs, keys, target_bytes, oversample, slack)
    first = np.concatenate(([0], np.cumsum(ways))).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((splitters, np.array(ways), first))
    columns = _key_columns(docs, keys)
    width, shards = len(columns), int(first[-1])

    @F.arrow_udf("int")
    def place(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        splitters, ways, first = shared.value
        own = _objects(splitters)
        for arrays in batches:
            at = np.searchsorted(own, encoded_keys(list(arrays[:width])), side="right")
            yield pa.array((first[at] + arrays[width].to_numpy() % ways[at]).astype(np.int32))

    marked = docs.withColumn(column, place(*columns, F.monotonically_increasing_id()))
    partitions = min(shards, PARTITIONS)
    return marked.repartitionById(partitions, F.floor(F.col(column) * F.lit(partitions) / shards).cast("int")).sortWithinPartitions(column, *columns[:-1])

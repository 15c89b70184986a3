"""Helpers that the training-data operators share.

Two groups: Spark helpers (shared scratch folder, lineage cuts, salted joins)
and byte-level text helpers that hash every word of an Arrow batch at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- Spark side


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster that
    names no shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauselake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and forgets its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or local path, and the path in it."""
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id is in fold 0)."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


# ------------------------------------------------------------- byte-level side

#: Bytes that end a word under the class [^\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
_SHORT = 64
_LANE, _START = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range.

    Eight bytes at a time are mixed into the hash of those before, by a bijection for every
    value of either; ranges of more than 64 bytes are hashed by XXH64.
    """
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mix64(length.astype(np.uint64) * _START)
    own, at, left = np.arange(len(start)), start, length
    for _ in range(_SHORT // 8):
        if len(own) and left.min(initial=1) <= 0:
            more = np.flatnonzero(left > 0)
            own, at, left = own[more], at[more], left[more]
        if not len(own):
            break
        lane = lanes[at] & _HEAD[np.minimum(left, 8)]
        out[own] = mix64(out[own] ^ (lane * _LANE))
        at, left = at + 8, left - 8
    for k in np.flatnonzero(length > _SHORT).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]].tobytes())
    return out


class Hasher:
    """Hashes of any byte ranges of one buffer, from prefix sums (polynomial mod 2^64).

    For ranges of some hundred bytes: there are texts of 1,024 bytes that no such hash can
    tell apart, whatever its base. Words, which may be of any length, are hashed by
    ``hash_words``.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + length * _CODE[0])


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column of strings (or of bytes without nulls) into runs of whole texts of about ``max_bytes``.

    Yields (first row, row after the last, bytes, offsets); null counts as empty.
    A text longer than ``max_bytes`` makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_ranges(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: a maximal run of bytes not in ``stops``."""
    n = len(data)
    inside = ~stops[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


# ------------------------------------------------------------------ skew, graphs

#: A key is heavy if more than 1/HEAVY_KEYS of all rows carry it, so fewer than this many are.
HEAVY_KEYS = 20000


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` inner join ``right`` on ``key``, without gathering a hot key in one task.

    ``right`` has one row per key, with the number of ``left`` rows that carry it in
    ``count``; ``total`` is the number of ``left`` rows. Rows of heavy keys meet a
    broadcast table of fewer than HEAVY_KEYS rows; all others are shuffled, and then no
    key has more than total / HEAVY_KEYS rows.
    """
    heavy = right.where(F.col(count) * F.lit(HEAVY_KEYS) > F.lit(total)).drop(count)
    light = right.where(F.col(count) * F.lit(HEAVY_KEYS) <= F.lit(total)).drop(count)
    return left.join(F.broadcast(heavy), key).unionByName(left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges (a, b) by stars that connect the same nodes, each to its smallest."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    ends = np.concatenate([np.concatenate(g) for g in zip(*got, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    u, v = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[u], label[v])
        for side in (u, v):
            np.minimum.at(label, before[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
    leaf = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf], pa.int64()), pa.array(nodes[label[leaf]], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every node's neighbours (the larger ones, or it and the smaller ones) move to the smallest."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = pairs if small else pairs.union(edges.select("b", "a"))
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("_m"), F.count("*").alias("_n")))
    total = least.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    joined = heavy_light_join(pairs, least, "u", "_n", total)
    moved = joined.select(F.col("v").alias("x"), F.col("_m").alias("y")) if small else joined.where("v > u").select(F.col("v").alias("x"), F.col("_m").alias("y"))
    moved = moved.union(least.select("u", "_m")) if small else moved
    return cut(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def connected_components(edges: DataFrame, task_edges: int = 1_000_000) -> DataFrame:
    """Labels the nodes of undirected ``edges`` (u, v) with the smallest node they reach.

    Each round first contracts the edges within partitions of about ``task_edges``, which
    bounds a task's memory. If one partition held them all, that is the answer; else a
    large-star and a small-star step move labels between partitions, until all edges
    lead from leaves to centres; alternating the two settles any graph. Rounds are cut by checkpoints. Returns (node,
    component), nodes with an edge only.
    """
    schema = "a long, b long"
    current = cut(edges.where("u <> v").select("u", "v").mapInArrow(_contract, schema))
    while True:
        parts = current.count() // task_edges + 1
        current = cut(current.repartition(parts).mapInArrow(_contract, schema))
        if parts > 1:
            current = _star(_star(current, small=False), small=True)
            loose = current.groupBy("a").count().where("count > 1").select("a").union(current.join(current.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a"))
        if parts == 1 or loose.isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b"), F.col("b")).distinct())

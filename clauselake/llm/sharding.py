"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group (the rows with equal texts) enters one shard whole, however large it is. Few
groups can be large: at most ``n_shards * grain`` exceed a 1/(n_shards * grain) share of
all bytes, so those are packed one by one; all smaller groups are first bundled by hash
into a fixed number of parcels, unless there are no more groups than parcels. The packer
therefore sees a number of items that parameters bound, whatever the input. Items above
the mean get shards of their own, the others share what is left, and a last pass moves
items from full shards to emptier ones while that brings the two closer.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


class RoomTree:
    """A treap of (room left, bin) pairs: insert, and take the tightest bin with enough room."""

    def __init__(self) -> None:
        self._root = None
        self._seed = 1

    def insert(self, key: tuple[int, int]) -> None:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        less, more = self._split(self._root, key)
        self._root = self._merge(self._merge(less, [key, self._seed, None, None]), more)

    def take(self, room: int) -> tuple[int, int] | None:
        """Removes and returns the smallest pair with at least ``room``; None if there is none."""
        less, more = self._split(self._root, (room, -1))
        if more is None:
            self._root = less
            return None
        first = more
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(more, (first[0][0], first[0][1] + 1))
        self._root = self._merge(less, rest)
        return first[0]

    def _split(self, node, key):
        """Subtrees of keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            less, more = self._split(node[3], key)
            return [node[0], node[1], node[2], less], more
        less, more = self._split(node[2], key)
        return less, [node[0], node[1], more, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """The bin of each item, bins numbered as opened; None once ``most_bins`` do not suffice.

    Items go by size, largest first (ties by position), each into the bin that it leaves
    the least room in; an item above the capacity gets a bin of its own.
    """
    bins, rooms, opened = [0] * len(sizes), RoomTree(), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take(sizes[k])
        if found is None:
            if opened == most_bins:
                return None
            found, opened = (max(capacity, sizes[k]), opened), opened + 1
        bins[k] = found[1]
        rooms.insert((found[0] - sizes[k], found[1]))
    return bins


def _fit(sizes: Sequence[int], n_bins: int, precision: float) -> list[int]:
    """Best-fit-decreasing into ``n_bins`` bins of the least capacity that bisection finds."""
    low = max(-(-sum(sizes) // n_bins), max(sizes))
    found, high, gap = best_fit_decreasing(sizes, low, n_bins), low, max(1, int(low * precision))
    while found is None:
        low, high, gap = high, high + gap, gap * 2
        found = best_fit_decreasing(sizes, high, n_bins)
    while high - low > max(1, low * precision):
        middle = (low + high) // 2
        better = best_fit_decreasing(sizes, middle, n_bins)
        low, high, found = (low, middle, better) if better is not None else (middle, high, found)
    return found


def _level(sizes: Sequence[int], bins: list[int], n_bins: int) -> list[int]:
    """Moves items from the fullest bin that has a fitting one to the emptiest, until none brings them closer.

    Of a bin's items smaller than the difference the one nearest to its half moves. Every
    move lowers the sum of squared loads, so the moves end.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_bins)]
    for k, b in enumerate(bins):
        held[b].append((sizes[k], k))
    for items in held:
        items.sort()
    loads = [sum(s for s, _ in items) for items in held]
    while True:
        low = min(range(n_bins), key=loads.__getitem__)
        for high in sorted(range(n_bins), key=lambda b: -loads[b]):
            gap = loads[high] - loads[low]
            upto = bisect_left(held[high], (gap, -1))
            if gap > 0 and upto:
                break
        else:
            return bins
        half = bisect_left(held[high], (gap / 2, -1))
        at = min((k for k in (half - 1, half) if 0 <= k < upto), key=lambda k: abs(2 * held[high][k][0] - gap))
        size, item = held[high].pop(at)
        insort(held[low], (size, item))
        loads[high], loads[low], bins[item] = loads[high] - size, loads[low] + size, low


def pack_into(sizes: Sequence[int], n_bins: int, precision: float = 5e-4) -> list[int]:
    """The bin of each item, bins as near to equal as indivisible items allow.

    Items above the mean of what is left get bins of their own, largest first; the others
    go best-fit-decreasing into the remaining bins, and are then levelled. No bin stays
    empty while another holds two items.
    """
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    bins, alone, left = [0] * len(sizes), 0, sum(sizes)
    while alone < min(len(order), n_bins - 1) and sizes[order[alone]] * (n_bins - alone) > left:
        bins[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    if rest:
        own = [sizes[k] for k in rest]
        for k, b in zip(rest, _level(own, _fit(own, n_bins - alone, precision), n_bins - alone), strict=True):
            bins[k] = alone + b
    return bins


def _local(spark, rows: Iterable[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def shard_documents(
    docs: DataFrame,
    *,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    parcels: int = 16384,
    grain: int = 32,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Puts every row into a shard so that shards have near-equal bytes (law ``bytes``).

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus
    ``overhead``), text_crc32, law, shard, slot (gapless from 0 in its shard, ordered by
    item, id and text hash), grown_shard (always null: only law ``key`` has one), and the
    input columns named in ``carry`` in a struct ``carried``.

    A null text counts and groups as an empty one. A null id is allowed; rows with the
    same id and text are interchangeable. Other columns are ignored, whatever their
    names. An empty table gives an empty result; with fewer groups than shards some
    shards stay empty. A group above a shard's share of the bytes has a shard to itself.
    Broadcast: at most the larger of n_shards * grain and ``parcels`` groups.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
        *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []),
    )
    rows = rows if carry else cut(rows)
    groups = cut(rows.groupBy("_h", "text_crc32").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")))
    total = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("g")).first()
    named = groups if total.g <= parcels else groups.where(F.col("_bytes") * F.lit(n_shards * grain) > F.lit(total.b))
    large = sorted((r._h, r.text_crc32) for r in named.select("_h", "text_crc32").collect())
    named = _local(spark, [(h, crc, parcels + k) for k, (h, crc) in enumerate(large)], "_h long, text_crc32 long, _big long")
    # Ranks are counted within (item, sub), so a hot item is spread over many tasks.
    subs = max(64, total.n // 1_000_000)
    placed = (
        rows.join(named, ["_h", "text_crc32"], "left")
        .withColumn("_item", F.coalesce(F.col("_big"), F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(parcels)).cast("long")))
        .withColumn("_sub", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(subs)))
    )
    units = cut(placed.groupBy("_item", "_sub").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes")))
    items = sorted((r._item, r.b) for r in units.groupBy("_item").agg(F.sum("_bytes").alias("b")).collect())
    bins = pack_into([b for _, b in items], n_shards)
    shards = _local(spark, [(item, shard) for (item, _), shard in zip(items, bins, strict=True)], "_item long, shard int")
    in_shard = Window.partitionBy("shard").orderBy("_item", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(units.join(shards, "_item").withColumn("_before", F.coalesce(F.sum("_n").over(in_shard), F.lit(0))).select("_item", "_sub", "shard", "_before"))
    rank = F.row_number().over(Window.partitionBy("_item", "_sub").orderBy("doc_id", "_h")) - 1
    return placed.join(offsets, ["_item", "_sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + rank).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["carried"] if carry else []),
    )

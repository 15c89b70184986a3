"""N-gram Jaccard self-join by T-occurrence search.

Two documents link if their shingle sets overlap enough; a set of n shingles must share
at least T = ceil(threshold * n) of them with any partner. The join runs in three steps,
none of which emits the pairs of a group:

1. Equal sets collapse to one representative.
2. Candidates. Of each set only a lead is looked at: the n - T + l smallest shingle
   hashes, of which partners must have l in common. Sets with too few lead shingles
   that any other set holds cannot have a partner. The rest are tied to others through
   their rarest lead shingles, and the ties' components are the shards of step 3.
3. In a shard, each set's inverted lists are divided: short ones are merged by a heap and
   keep the sets with T - L occurrences, the L longest are probed by binary search (DivideSkip).
   Where only classes are asked for, sets already connected to the query are passed over;
   else every link is verified and counted where it is found, and no pair leaves the task.

A component above ``block`` sets is cut into blocks, and every pair of blocks is searched.
A block is written once to the shared folder, and the tasks of its pairs read it there:
sent to each of them, the sets of a component would be copied once for every block it has.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_table, connected_components, cut, fresh_path, hash_words, heavy_light_join, mix64, open_fs, text_slices, word_ranges

#: Of the shingles beyond n - T, a lead holds n // LEAD (one at least).
LEAD = 6
#: The side of sets in a task that searches all its pairs; sides 0 and 1 are two blocks whose cross pairs are searched.
WITHIN = -1
#: Pairs of blocks are dealt to at most so many tasks, each of which reads one pair at a time.
MOST_TASKS = 10_000


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (all its words if it has fewer than ``width``)."""
    for first, last, data, offsets in text_slices(column):
        low = LOWER[data]
        start, end, owner = word_ranges(low, offsets)
        words = hash_words(low, start, end)
        at = np.searchsorted(owner, np.arange(last - first + 1))
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k] + np.uint64(k))
        for k in range(last - first):
            a, b = at[k], at[k + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.full(1, b - a, dtype=np.uint64)
                for w in range(a, b):
                    whole = mix64(whole * np.uint64(31) + words[w : w + 1])
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)


def least_overlap(n: int, num: int, den: int) -> int:
    """T: what a set of ``n`` must share with any partner."""
    return -(-num * n // den)


def lead_length(n: int, num: int, den: int) -> int:
    return min(n, n - least_overlap(n, num, den) + max(1, n // LEAD))


def lead_needed(n: int, num: int, den: int) -> int:
    """Lead shingles that a set of ``n`` must share with a partner, the smallest possible one included."""
    return min(max(1, least_overlap(n, num, den) // LEAD), lead_length(n, num, den))


def _set_key(shingles: np.ndarray) -> bytes:
    salted = mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    return np.array([shingles.sum(dtype=np.uint64), salted.sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def _lead_rows(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, leads = [], [], []
            for found in shingle_sets(batch.column("_text"), width):
                sizes.append(len(found))
                keys.append(_set_key(found))
                leads.append(found[: lead_length(len(found), num, den)].view(np.int64))
            bounds = np.cumsum([0, *map(len, leads)]).astype(np.int32)
            values = np.concatenate(leads) if leads else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))], names=["doc_id", "n", "set_key", "lead"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [s.tobytes() for s in shingle_sets(part.column("_text"), width)]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("task", "component", "own", "node", "weight")), pa.array(sets, pa.binary())], names=["task", "component", "own", "node", "weight", "shingles"])

    return run


def heap_merge(lists: list[list[int]], needed: int) -> list[tuple[int, int]]:
    """(element, lists that hold it) of the elements that ``needed`` or more of the sorted ``lists`` hold, by a heap of their heads."""
    heap = [(own[0], k, 0) for k, own in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    while heap:
        least, times = heap[0][0], 0
        while heap and heap[0][0] == least:
            _, k, at = heap[0]
            times += 1
            if at + 1 < len(lists[k]):
                heapq.heapreplace(heap, (lists[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if times >= needed:
            out.append((least, times))
    return out


class InvertedLists:
    """Inverted lists of ``sets`` taken in the order of sizes; each set asks for smaller ones.

    With two sides (0 and 1) only pairs across them are searched.
    """

    def __init__(self, sets: list[np.ndarray], sides: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
        self.sizes = np.array([len(sets[k]) for k in self.order])
        self.side = np.asarray(sides)[self.order]
        self.across = len(set(self.side.tolist())) > 1
        owner = np.repeat(np.arange(len(self.order)), self.sizes)
        _, self.token, self.held = np.unique(np.concatenate([sets[k] for k in self.order]), return_inverse=True, return_counts=True)
        self.bounds = np.cumsum([0, *self.held])
        self.lists = owner[np.argsort(self.token, kind="stable")]
        self.own = np.cumsum([0, *self.sizes])

    def whole(self, x: int) -> np.ndarray:
        return self.token[self.own[x] : self.own[x + 1]]

    def divide(self, x: int) -> tuple[list[np.ndarray], list[np.ndarray], int] | None:
        """The short lists of ``x``, cut to the sets it asks for; the long ones, shortest first; and T - L. None if no set can link."""
        needed = least_overlap(int(self.sizes[x]), self.num, self.den)
        low = int(np.searchsorted(self.sizes, needed))
        mine = self.whole(x)
        mine = mine[self.held[mine] > 1]
        if low >= x or len(mine) < needed:
            return None
        mine = mine[np.argsort(self.held[mine], kind="stable")]
        long = min(needed - 1, max(int(needed / (0.01 * math.log2(max(2, int(self.held[mine[-1]]))) + 1)), needed - 8))
        short = []
        for t in mine[: len(mine) - long]:
            near = self.lists[self.bounds[t] : self.bounds[t + 1]]
            near = near[np.searchsorted(near, low) : np.searchsorted(near, x)]
            near = near[self.side[near] != self.side[x]] if self.across else near
            if len(near):
                short.append(near)
        if len(short) < needed - long:
            return None
        return short, [self.lists[self.bounds[t] : self.bounds[t + 1]] for t in mine[len(mine) - long :]], needed - long

    def wanted(self, x: int, y: int | np.ndarray) -> int | np.ndarray:
        """The overlap at which ``x`` and ``y`` link."""
        return -(-self.num * (self.sizes[x] + self.sizes[y]) // (self.num + self.den))


def search_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what links connect: a spanning forest over positions in ``sets``.

    A set first tries the last set of its shortest list; if they link, that class is out
    of its lists before these are merged, so a large class of near copies costs no
    merging of its own lists.
    """
    held = InvertedLists(sets, sides, num, den)
    comp = np.arange(len(held.order))
    links = []

    def link(x: int, y: int) -> None:
        links.append((held.order[x], held.order[y]))
        comp[comp == comp[x]] = comp[y]

    for x in range(len(held.order)):
        divided = held.divide(x)
        if divided is None:
            continue
        short, long, least = divided
        y = int(min(short, key=len)[-1])
        if len(np.intersect1d(held.whole(x), held.whole(y), assume_unique=True)) >= held.wanted(x, y):
            link(x, y)
        short = [near[comp[near] != comp[x]] for near in short]
        merged = heap_merge([near.tolist() for near in short if len(near)], least)
        merged.sort(key=lambda found: -found[1])
        for y, have in merged:
            if comp[y] == comp[x]:
                continue
            want, left = int(held.wanted(x, y)), len(long)
            for probed in reversed(long):
                if have >= want or have + left < want:
                    break
                left -= 1
                at = bisect_left(probed, y)
                have += at < len(probed) and probed[at] == y
            if have >= want:
                link(x, y)
    return links


def search_all_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every link, as positions in ``sets``: (x, the smaller sets that link with it)."""
    held = InvertedLists(sets, sides, num, den)
    order = np.array(held.order)
    for x in range(len(order)):
        divided = held.divide(x)
        if divided is None:
            continue
        short, long, least = divided
        merged = heap_merge([near.tolist() for near in short], least)
        if not merged:
            continue
        y, have = np.array(merged).T
        want = held.wanted(x, y)
        linked = []
        for left in range(len(long), -1, -1):
            linked.append(y[have >= want])
            open_ = (have < want) & (have + left >= want)
            y, have, want = y[open_], have[open_], want[open_]
            if not len(y):
                break
            probed = long[left - 1]
            at = np.minimum(np.searchsorted(probed, y), len(probed) - 1)
            have = have + (probed[at] == y)
        found = np.concatenate(linked)
        if len(found):
            yield int(order[x]), order[found]


def _links_of(num: int, den: int, count_links: bool):
    """Links (u, v, n_links) among ``nodes`` or, with two ``sides``, across them; with ``count_links`` also rows u = v with the links of a node."""

    def run(nodes: np.ndarray, sides: np.ndarray, weights: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
        n_links = np.zeros(len(nodes), dtype=np.int64)
        if not count_links:
            links = search_links(sets, sides, num, den)
        else:
            links, comp = [], np.arange(len(nodes))
            again = len(np.unique(nodes)) < len(nodes)
            first = {int(node): k for k, node in reversed(list(enumerate(nodes)))} if again else {}
            seen = set()
            for x, ys in search_all_links(sets, sides, num, den):
                if again:  # Rows that share a node are one document: a pair of nodes counts once.
                    x, ys = first[int(nodes[x])], np.unique([first[int(nodes[y])] for y in ys])
                    ys = np.array([y for y in ys.tolist() if y != x and (min(x, y), max(x, y)) not in seen], dtype=np.int64)
                    seen.update((min(x, y), max(x, y)) for y in ys.tolist())
                n_links[x] += weights[ys].sum()
                n_links[ys] += weights[x]
                fresh = ys[comp[ys] != comp[x]]
                links += [(x, int(y)) for y in fresh[np.unique(comp[fresh], return_index=True)[1]]]
                comp[np.isin(comp, comp[fresh])] = comp[x]
        u, v = ([int(nodes[link[k]]) for link in links] for k in (0, 1))
        some = np.flatnonzero(n_links)
        return u + nodes[some].tolist(), v + nodes[some].tolist(), [0] * len(u) + n_links[some].tolist()

    return run


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    table = table.combine_chunks()
    return table.column("node").to_numpy(), table.column("weight").to_numpy(), [np.frombuffer(s.as_py(), dtype=np.uint64) for s in table.column("shingles")]


def _search_shard(num: int, den: int, count_links: bool, folder: str):
    """The links of whole small components; of a block of a large one, the file in ``folder`` to which it is written."""
    links_of = _links_of(num, den, count_links)

    def run(table: pa.Table) -> pa.Table:
        component, own = table.column("component")[0].as_py(), table.column("own")[0].as_py()
        u, v, n_links, path = [], [], [], None
        if component is None:
            nodes, weights, sets = _columns(table)
            u, v, n_links = links_of(nodes, np.full(len(nodes), WITHIN), weights, sets)
        else:
            path = f"{folder}/{uuid.uuid4().hex}"
            store, inner = open_fs(path)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            kept = table.select(["node", "weight", "shingles"])
            with store.open_output_stream(inner) as out, pa.ipc.new_stream(out, kept.schema) as writer:
                writer.write_table(kept)
            u, v, n_links = [None], [None], [None]
        n = len(u)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "component": pa.array([component] * n, pa.int64()), "own": pa.array([own] * n, pa.int32()), "path": pa.array([path] * n, pa.string())})

    return run


def _read_block(path: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    store, inner = open_fs(path)
    with store.open_input_stream(inner) as raw:
        return _columns(pa.ipc.open_stream(raw).read_all())


def _search_pairs(num: int, den: int, count_links: bool):
    """The links within a block (a pair of it and itself) or across two blocks, from their files."""
    links_of = _links_of(num, den, count_links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist(), strict=True):
                nodes, weights, sets = _read_block(one)
                sides = np.full(len(nodes), WITHIN)
                if other != one:
                    more, theirs, their_sets = _read_block(other)
                    sides = np.repeat([0, 1], [len(nodes), len(more)])
                    nodes, weights, sets = np.append(nodes, more), np.append(weights, theirs), sets + their_sets
                found = links_of(nodes, sides, weights, sets)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["u", "v", "n_links"])

    return run


def similar_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = 90,
    den: int = 100,
    block: int = 1024,
    shard_sets: int = 512,
    most_broadcast: int = 1_000_000,
    count_links: bool = False,
) -> DataFrame:
    """Classes of documents under links: den * intersection >= num * union of shingle sets.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, its own included). With ``count_links`` also n_links, the number
    of other rows that the row links with, those of equal sets included; links between
    different sets are then all searched and not only as many as connect a class. Links
    are exact but for collisions of 64-bit shingle hashes.

    A null or empty text, or one without words, has an empty set and stands alone. Rows
    with a null id share the class of an equal set and add no id to it; alone they have
    a null component. Rows that repeat an id count as one document; where their sets
    differ, they share the links to other sets. Other columns are ignored. An empty table gives an empty result. Whole texts are used.

    ``block`` bounds the sets in a search task, twice for a pair of blocks; the ids of
    candidates are broadcast only up to ``most_broadcast`` of them and joined beyond.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    leads = as_table(rows.mapInArrow(_lead_rows(width, num, den), "doc_id long, n long, set_key binary, lead array<long>"), "leads")
    with_words = leads.where("n > 0")
    equal = as_table(with_words.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.count("*").alias("_rows"), F.first("lead").alias("lead")), "sets")
    postings = equal.where("node IS NOT NULL").select("node", "n", F.explode("lead").alias("token"))
    counted = as_table(postings.groupBy("token").agg(F.count("*").alias("_held")).where("_held > 1"), "tokens").withColumn("held", F.col("_held"))
    total = int(equal.agg(F.coalesce(F.sum(F.size("lead")), F.lit(0))).first()[0])
    shared = heavy_light_join(postings, counted, "token", "_held", total)
    # lead_needed() and least_overlap() as expressions.
    overlap = F.ceil(F.col("n") * F.lit(num) / F.lit(den))
    need = F.least(F.greatest(F.lit(1), F.floor(overlap / LEAD)), F.col("n") - overlap + F.greatest(F.lit(1), F.floor(F.col("n") / LEAD)))
    held = (
        shared.groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("_tokens"))
        .withColumn("_need", need.cast("int"))
        .where(F.size("_tokens") >= F.col("_need"))
    )
    rare = cut(held.select("node", F.explode(F.expr("slice(_tokens, 1, size(_tokens) - _need + 1)")).alias("_t")).select("node", F.col("_t.token").alias("token")))
    leaders = cut(rare.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("_held")))
    ties = heavy_light_join(rare, leaders, "token", "_held", rare.count()).select(F.col("node").alias("u"), F.col("leader").alias("v"))
    ties = connected_components(ties)
    weights = equal.groupBy("node").agg(F.sum("_rows").alias("weight"))
    tasks = _search_tasks(ties, block, shard_sets)
    tasks = cut(tasks.join(weights, "node") if count_links else tasks.withColumn("weight", F.lit(1).cast("long")))
    n_tasks = tasks.count()
    candidates = tasks.join(rows.withColumnRenamed("doc_id", "node"), "node") if n_tasks > most_broadcast else rows.withColumnRenamed("doc_id", "node").join(F.broadcast(tasks), "node")
    sets = candidates.select("task", "component", "own", "node", "weight", "_text").mapInArrow(_set_rows(width), "task string, component long, own int, node long, weight long, shingles binary")
    search = _search_shard(num, den, count_links, fresh_path(docs.sparkSession, "blocks"))
    searched = as_table(sets.groupBy("task").applyInArrow(search, "u long, v long, n_links long, component long, own int, path string"), "searched")
    links, blocks = searched.where("path IS NULL").select("u", "v", "n_links"), searched.where("path IS NOT NULL")
    pairs = cut(blocks.select("component", "own", F.col("path").alias("one")).join(blocks.select("component", F.col("own").alias("_other"), F.col("path").alias("other")), "component").where("own <= _other").select("one", "other"))
    n_pairs = pairs.count()
    if n_pairs:
        across = pairs.repartition(min(n_pairs, MOST_TASKS)).mapInArrow(_search_pairs(num, den, count_links), "u long, v long, n_links long")
        links = links.union(as_table(across, "links") if count_links else across)
    classes = connected_components(links).withColumnRenamed("node", "_node")
    if count_links:
        classes = classes.join(links.where("u = v").groupBy(F.col("u").alias("_node")).agg(F.sum("n_links").alias("_links")), "_node", "left")
    others = [(F.coalesce("_links", F.lit(0)) + F.col("_rows") - 1).alias("n_links")] if count_links else []
    known = cut(
        equal.select("set_key", "node", "_rows")
        .join(classes, F.col("node") == F.col("_node"), "left")
        .select("set_key", F.coalesce("component", "node").alias("component_id"), *others, "_rows")
    )
    found = heavy_light_join(with_words.select("set_key", "doc_id", "n"), known, "set_key", "_rows", leads.count())
    names = ["n_links"] if count_links else []
    alone = leads.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(name) for name in names])
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *names).union(alone)


def _search_tasks(ties: DataFrame, block: int, shard_sets: int) -> DataFrame:
    """The search task of each node (task, node, component, own): whole small components share shards; ``component`` and ``own`` say the block of a large one."""
    sizes = cut(ties.groupBy("component").agg(F.count("*").alias("_n")))
    total = ties.count()
    sized = heavy_light_join(ties, sizes.withColumn("_size", F.col("_n")), "component", "_n", total)
    shards = max(1, total // shard_sets)
    large = F.col("_size") > block
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("_size") / F.lit(block)).cast("int")).cast("int")
    return sized.select("node", F.when(large, F.col("component")).alias("component"), F.when(large, own).alias("own"), F.pmod(F.xxhash64("component"), F.lit(shards)).alias("_shard")).select(
        F.when(F.col("component").isNull(), F.concat(F.lit("s"), "_shard")).otherwise(F.concat_ws("-", F.lit("b"), "component", "own")).alias("task"), "node", "component", "own"
    )

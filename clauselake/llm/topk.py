"""Exact top-k inner-product search with a ball tree per shard.

Candidates are dealt to cells of near vectors, by the nearest of a bounded number of
centres, and a large cell is cut into shards of bounded size; each shard's ball tree is
built once. Every query visits its own cell first and then the others, from the highest
bound  q . centre + |q| * radius  down, in waves: what a wave finds raises the query's k-th
score, cells whose bound is under it are never visited, and a tree is sent only to blocks
of queries that visit it. Within a tree the same bound leaves out subtrees.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, cut


class BallTree:
    """A binary tree of balls over integer vectors; leaves are runs of the reordered rows."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = 64):
        order, nodes = np.arange(len(ids)), []

        def build(first: int, last: int, parent: int) -> None:
            own = rows[order[first:last]].astype(np.float64)
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            me = len(nodes)
            nodes.append([parent, first, last, centre, away.max(), True])
            if last - first <= leaf or away.max() == 0:
                return
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = np.argsort(own @ (other - far), kind="stable")
            order[first:last] = order[first:last][side]
            nodes[me][5] = False
            middle = (first + last) // 2
            build(first, middle, me)
            build(middle, last, me)

        if len(ids):
            build(0, len(ids), -1)
        self.keys, self.ids, self.rows = keys[order], ids[order], rows[order]
        self.parent = np.array([n[0] for n in nodes], dtype=np.int64)
        self.first = np.array([n[1] for n in nodes], dtype=np.int64)
        self.last = np.array([n[2] for n in nodes], dtype=np.int64)
        self.centre = np.array([n[3] for n in nodes]).reshape(len(nodes), rows.shape[1])
        self.radius = np.array([n[4] for n in nodes])
        self.is_leaf = np.array([n[5] for n in nodes], dtype=bool)

    def search(self, keys: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, score) of all that can be among the ``k`` best.

        ``kth``: the k-th score that each query has from elsewhere. The smallest ids win
        ties; the row with a query's own key is left out.
        """
        exact = float(np.abs(self.rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**53
        left, right = (self.rows.astype(np.float64), queries.astype(np.float64)) if exact else (self.rows, queries)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        reach = norms[:, None] * self.radius
        bound = queries.astype(np.float64) @ self.centre.T + reach
        bound += 1e-9 * (np.abs(bound) + reach) + 1e-6
        kth = kth.astype(np.float64)
        for node in range(1, len(self.parent)):  # parents come first
            np.minimum(bound[:, node], bound[:, self.parent[node]], out=bound[:, node])
        leaves = np.flatnonzero(self.is_leaf)
        turn = np.argsort(-bound[:, leaves], axis=1, kind="stable")
        best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        active = np.arange(len(keys))
        for step in range(len(leaves)):
            at = leaves[turn[active, step]]
            open_ = bound[active, at] >= kth[active]
            active, at = active[open_], at[open_]
            if not len(active):
                break
            new = [(best_q, best_id, best_s)]
            by_leaf = np.argsort(at, kind="stable")
            for group in np.split(by_leaf, np.flatnonzero(np.diff(at[by_leaf])) + 1):
                q, node = active[group], at[group[0]]
                own = slice(self.first[node], self.last[node])
                score = right[q] @ left[own].T
                hit_q, hit_v = np.nonzero((score >= kth[q][:, None]) & (self.keys[own] != keys[q][:, None]))
                new.append((q[hit_q], self.ids[own][hit_v], score[hit_q, hit_v].astype(np.int64)))
            if len(new) == 1:
                continue
            q, v, s = (np.concatenate(x) for x in zip(*new, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            starts = np.searchsorted(q, q)
            place = np.arange(len(q)) - starts
            best_q, best_id, best_s = q[place < k], v[place < k], s[place < k]
            full = np.flatnonzero(place == k - 1)
            np.maximum.at(kth, q[full], s[full].astype(np.float64))
        return best_q, best_id, best_s


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.int64)


def _build_tree(table: pa.Table) -> pa.Table:
    keys, ids, rows = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), _vectors(table.column("vector"))
    order = np.lexsort((keys, ids))
    tree = BallTree(keys[order], ids[order], rows[order])
    return pa.table({**{c: table.column(c)[:1] for c in _SHARD}, "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})


def _search_cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        if not trees.num_rows:  # a shard that the hash left empty
            queries = queries.slice(0, 0)
            return pa.table({"query": queries.column("query"), "query_id": queries.column("query_id"), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        keys = queries.column("query").to_numpy()
        kth = queries.column("kth").fill_null(-(1 << 63)).to_numpy()
        q, v, s = pickle.loads(trees.column("tree")[0].as_py()).search(keys, _vectors(queries.column("vector")), kth, k)
        return pa.table({"query": pa.array(keys[q], pa.int64()), "query_id": queries.column("query_id").take(pa.array(q)), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


_SHARD = ("dims", "cell", "sub")


def cell_centres(sample: np.ndarray, n: int, steps: int = 5) -> np.ndarray:
    """Centres of ``n`` cells (fewer if rows repeat), by a few steps of k-means over ``sample``."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(np.int64)].astype(np.float64)
    for _ in range(steps):
        own = nearest(centres, sample)
        centres = np.array([sample[own == c].mean(axis=0) for c in np.unique(own)])
    return centres


def nearest(centres: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (rows.astype(np.float64) @ centres.T)).argmin(axis=1)


def _into_cells(centres: dict[int, np.ndarray]):
    """Each vector's cell and its distance from the centre; all is one cell where a length has no centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                rows = _vectors(pa.chunked_array([batch.column("vector").take(pa.array(at))])).astype(np.float64)
                own = centres.get(d, np.zeros((1, d)))
                cell[at] = nearest(own, rows)
                away[at] = np.sqrt(((rows - own[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _visits(centres: dict[int, np.ndarray], radius: dict[tuple[int, int], float], done: int, upto: int):
    """The cells that a query visits in turns ``done`` to ``upto``, its own first, then from the highest bound down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own_cell = batch.column("dims").to_numpy(), batch.column("cell").to_numpy()
            kth = batch.column("kth").cast(pa.float64()).fill_null(-np.inf).to_numpy()
            picked, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                rows = _vectors(pa.chunked_array([batch.column("vector").take(pa.array(at))])).astype(np.float64)
                held = np.array(sorted(c for e, c in radius if e == d))
                middle = centres.get(d, np.zeros((1, d)))[held]
                reach = np.sqrt((rows**2).sum(axis=1))[:, None] * np.array([radius[d, c] for c in held])
                bound = rows @ middle.T + reach
                bound += 1e-9 * (np.abs(bound) + reach) + 1e-6
                order = np.argsort(np.where(held == own_cell[at][:, None], -np.inf, -bound), axis=1, kind="stable")[:, done:upto]
                q, turn = np.nonzero(np.take_along_axis(bound, order, axis=1) >= kth[at][:, None])
                picked.append(at[q])
                cells.append(held[order[q, turn]])
            rows = pa.array(np.concatenate(picked))
            names = ["query", "query_id", "vector", "dims", "kth", "block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), pa.array(np.concatenate(cells), pa.int32())], names=[*names, "cell"])

    return run


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component, as a double; null unless all are finite."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(embedding.isNotNull() & sound, F.transform(doubles, lambda x: F.floor(x * 256).cast("long")))


def exact_top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 50,
    k: int = 5,
    shard_rows: int = 8192,
    query_block: int = 4096,
    most_cells: int = 256,
) -> DataFrame:
    """The ``k`` best of all other vectors for each vector whose id ``query_every`` divides.

    Returns query_id, rank (from 1), vec_id, score (integer inner product of the vectors'
    quantised components); fewer than ``k`` rows where there are fewer candidates. Ties
    go to the smaller vec_id.

    Left out: rows whose id is null, and vectors that are null, empty, or hold a null or
    non-finite component. Every other row is a candidate of its own, also those that
    repeat an id; only a query's own row is none for it. A repeated query id has results
    for each of its rows. Vectors of different lengths have no inner product, so a query
    meets those of its own length. Scores must fit 64 bits. Columns of other names are
    ignored. An empty table gives an empty result.

    A search task holds one tree of about ``shard_rows`` vectors and one block of about
    ``query_block`` queries, however many there are of either. The driver gets at most 64
    vectors for each of the ``most_cells`` cells, to place their centres, and one radius a cell.
    """
    known = cut(
        vectors.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("vector"))
        .where("vector IS NOT NULL AND size(vector) > 0")
        .withColumns({"dims": F.size("vector"), "row": F.monotonically_increasing_id()})
    )
    n = known.count()
    n_cells = min(most_cells, -(-n // shard_rows)) or 1
    centres = {}
    sample = known.orderBy(F.xxhash64("vec_id", "vector")).limit(64 * n_cells).select("dims", "vector").toArrow() if n_cells > 1 else None
    for d in sorted(set(sample.column("dims").to_pylist())) if n_cells > 1 else []:
        own = _vectors(sample.filter(pc.equal(sample.column("dims"), d)).column("vector"))
        centres[d] = cell_centres(own, n_cells)
    celled = cut(known.mapInArrow(_into_cells(centres), "vec_id long, vector array<long>, dims int, row long, cell int, away double"))
    cells = celled.groupBy("dims", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    radius = {(r.dims, r.cell): r.radius for r in cells}
    subs = F.broadcast(known.sparkSession.createDataFrame([(r.dims, r.cell, -(-r.n // shard_rows)) for r in cells], "dims int, cell int, subs int"))
    sharded = celled.join(subs, ["dims", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")).select(*_SHARD, "row", "vec_id", "vector")
    trees = as_table(sharded.groupBy(*_SHARD).applyInArrow(_build_tree, "dims int, cell int, sub int, tree binary"), "trees")
    asked = celled.where(F.col("vec_id") % query_every == 0)
    n_blocks = -(-asked.count() // query_block) or 1
    queries = cut(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "vector", "dims", "cell", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(n_blocks)).cast("int").alias("block")))
    best, done, most = None, 0, max([c + 1 for _, c in radius], default=1)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    while done < most:
        # The first wave is the own cell, so that all others are met with a k-th score in hand.
        upto = min(most, max(1, done * 8))
        bounded = queries.withColumn("kth", F.lit(None).cast("long")) if best is None else queries.join(best.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")), "query", "left")
        visits = cut(bounded.mapInArrow(_visits(centres, radius, done, upto), "query long, query_id long, vector array<long>, dims int, kth long, block int, cell int"))
        if best is not None and visits.isEmpty():
            break
        visits = visits.join(subs, ["dims", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
        wanted = visits.select(*[F.col(c).alias(f"_{c}") for c in (*_SHARD, "block")]).distinct()
        sent = trees.join(wanted, [F.col(c) == F.col(f"_{c}") for c in _SHARD]).select(*_SHARD, "tree", F.col("_block").alias("block"))
        keys = (*_SHARD, "block")
        found = sent.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_search_cell(k), "query long, query_id long, vec_id long, score long")
        best = cut((found if best is None else found.unionByName(best.drop("rank"))).withColumn("rank", place).where(F.col("rank") <= k))
        done = upto
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

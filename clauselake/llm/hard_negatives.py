"""Hard negatives by inner product, with a pivot table.

A row x of norm at most M gets one component more, sqrt(M^2 - |x|^2), and an anchor q a
zero; then  |q - x|^2 = |q|^2 + M^2 - 2 q.x , so a high score is a small distance. Every
row's distances to a few pivots are stored. By the triangle inequality a row's distance
from an anchor lies between the largest |d(q, p) - d(x, p)| and the smallest
d(q, p) + d(x, p), which brackets its score; only rows whose bracket reaches into what is
asked are scored exactly. A shard of rows has the least and greatest distance to every
pivot, so whole shards are left out in the same way.

Positives are the best rows of the anchor's label. Each opens a window of scores for
negatives, and an anchor looks for all its windows at once, shards of the highest bound
first, in waves that share what the earlier ones found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, cut
from .topk import quantised

#: Distances of a row are put into so many rings around its nearest pivot.
RINGS = 256
_LOW, _HIGH = -(1 << 62), 1 << 62


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(kind)


def _distances(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows with the added component ``extra`` to the pivots, whose last component is theirs."""
    rows = rows.astype(np.float64)
    return np.stack([np.sqrt(((rows - p[:-1]) ** 2).sum(axis=1) + (extra - p[-1]) ** 2) for p in pivots], axis=1)


def _added(rows: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, top - (rows.astype(np.float64) ** 2).sum(axis=1)))


def choose_pivots(sample: np.ndarray, top: float, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, with their added component, each the farthest from those before."""
    rows = np.concatenate([sample.astype(np.float64), _added(sample, top)[:, None]], axis=1)
    picked = [rows[0]]
    away = ((rows - picked[0]) ** 2).sum(axis=1)
    while len(picked) < n and away.max() > 0:
        picked.append(rows[away.argmax()])
        away = np.minimum(away, ((rows - picked[-1]) ** 2).sum(axis=1))
    return np.array(picked)


class Space:
    """Pivots and the greatest squared norm for each length of vectors."""

    def __init__(self, pivots: dict[int, np.ndarray], top: dict[int, float]):
        self.pivots, self.top = pivots, top

    def bounds(self, dims: int, norm: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of rows between the distances ``near`` and ``far`` of anchors of squared norm ``norm``."""
        sum_ = norm + self.top[dims]
        slack = 1e-9 * sum_ + 1e-3
        return (sum_ - far**2) / 2 - slack, (sum_ - near**2) / 2 + slack


def _pivot_table(space: Space) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a row's distances to the pivots and its bin: nearest pivot and ring around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            away, bins = [None] * len(dims), np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                rows = _matrix(batch.column("vector").take(pa.array(at)), np.int64)
                got = _distances(rows, _added(rows, space.top[d]), space.pivots[d])
                near = got.argmin(axis=1)
                # No distance from the nearest pivot is beyond twice the radius of the sphere.
                bins[at] = near * RINGS + np.minimum(RINGS - 1, got.min(axis=1) / (2 * np.sqrt(space.top[d]) + 1e-9) * RINGS).astype(np.int64)
                for k, row in zip(at.tolist(), got, strict=True):
                    away[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away, pa.list_(pa.float64())), pa.array(bins, pa.int64())], names=[*batch.schema.names, "away", "bin"])

    return run


def pack_bins(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Adds ``name``: runs of neighbouring bins of a key with about ``size`` rows; a bin of more is dealt by hash."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select(*keys, "bin", F.floor(F.coalesce(before, F.lit(0)) / size).alias("_first"), F.ceil(F.col("_n") / size).alias("_parts"))
    return rows.join(places, [*keys, "bin"]).withColumn(name, (F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_parts"))).cast("int")).drop("_first", "_parts")


_SHARD = ("dims", "bucket", "shard")


def _as_shard(table: pa.Table) -> pa.Table:
    """One row for a shard: its rows ordered by distance from its first pivot's, and the range of each distance."""
    away = _matrix(table.column("away"), np.float64)
    order = np.lexsort((table.column("row").to_numpy(), away[:, 0]))
    table, away = table.take(pa.array(order)), away[order]
    whole = lambda x: pa.array([x])
    return pa.table(
        {
            **{c: table.column(c)[:1] for c in _SHARD},
            "rows": whole(table.column("row").to_pylist()),
            "ids": whole(table.column("vec_id").to_pylist()),
            "labels": whole(table.column("label").to_pylist()),
            "vectors": pa.array([_matrix(table.column("vector"), np.int64).tobytes()], pa.binary()),
            "table": pa.array([np.ascontiguousarray(away.T).tobytes()], pa.binary()),
            "near": whole(away.min(axis=0).tolist()),
            "far": whole(away.max(axis=0).tolist()),
        }
    )


_SHARD_SCHEMA = "dims int, bucket int, shard int, rows array<long>, ids array<long>, labels array<string>, vectors binary, table binary, near array<double>, far array<double>"


class Windows:
    """An anchor's windows of scores, each with the ``k`` best (score, id) so far."""

    def __init__(self, least: list[int], most: list[int], k: int):
        self.least, self.most, self.k = list(least), list(most), k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in least]

    def floor(self) -> int:
        return min(self.least)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (least, most) in enumerate(zip(self.least, self.most, strict=True)):
            own = (scores >= least) & (scores <= most)
            if not own.any():
                continue
            s, i = np.concatenate([self.best[w][0], scores[own]]), np.concatenate([self.best[w][1], ids[own]])
            order = np.lexsort((i, -s))[: self.k]
            self.best[w] = s[order], i[order]
            if len(order) == self.k:
                self.least[w] = int(s[order[-1]])


def search_shard(space: Space, dims: int, shard: dict, row: int, label: str, vector: np.ndarray, windows: Windows, same: bool, chunk: int = 256) -> int:
    """Adds to an anchor's windows what the shard has for it; returns how many rows were scored."""
    norm = float((vector.astype(np.float64) ** 2).sum())
    own = _distances(vector[None], np.zeros(1), space.pivots[dims])[0]
    # By the first pivot alone, the rows that can reach the floor are a run of the shard.
    first = shard["table"][0]
    reach = np.sqrt(max(0.0, norm + space.top[dims] - 2.0 * (windows.floor() - 1e-3)) * (1 + 1e-9)) if windows.floor() > _LOW else np.inf
    run = slice(*np.searchsorted(first, [own[0] - reach, own[0] + reach + 1e-6]))
    at = np.arange(run.start, run.stop)
    at = at[((shard["labels"][run] == label) == same) & (shard["rows"][run] != row)]
    near, far = np.zeros(len(at)), np.full(len(at), np.inf)
    for p, of in enumerate(own):
        away = shard["table"][p][at]
        np.maximum(near, np.abs(away - of), out=near)
        np.minimum(far, away + of, out=far)
    lower, upper = space.bounds(dims, norm, near, far)
    keep = np.flatnonzero((upper >= windows.floor()) & (lower <= max(windows.most)))
    keep = keep[np.argsort(-upper[keep], kind="stable")]
    scored = 0
    for turn in range(0, len(keep), chunk):
        part = keep[turn : turn + chunk]
        part = part[upper[part] >= windows.floor()]
        if not len(part):
            break
        scored += len(part)
        windows.add(shard["vectors"][at[part]] @ vector, shard["ids"][at[part]])
    return scored


_FOUND = "query long, window int, vec_id long, score long"


def _search(space: Space, k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(shards: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        for s in range(shards.num_rows if anchors.num_rows else 0):
            cell = {c: shards.column(c)[s] for c in ("rows", "ids", "labels", "vectors", "table", "dims")}
            dims = cell["dims"].as_py()
            shard = {c: cell[c].values.to_numpy(zero_copy_only=False) for c in ("rows", "ids", "labels")}
            shard["vectors"] = np.frombuffer(cell["vectors"].as_py(), dtype=np.int64).reshape(-1, dims)
            shard["table"] = np.frombuffer(cell["table"].as_py(), dtype=np.float64).reshape(len(space.pivots[dims]), -1)
            vectors = _matrix(anchors.column("vector"), np.int64)
            for n, (query, label, least, most) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("query", "label", "least", "most")), strict=True)):
                windows = Windows(least, most, k)
                search_shard(space, dims, shard, query, label, vectors[n], windows, same)
                for w, (scores, ids) in enumerate(windows.best):
                    found.append([np.full(len(ids), query), np.full(len(ids), w), ids, scores])
        query, window, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        return pa.table({"query": pa.array(query, pa.int64()), "window": pa.array(window, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


_ASKED = ["query", "label", "vector", "dims", "bucket", "block", "least", "most"]


def _visits(space: Space, boxes: dict[int, tuple[np.ndarray, ...]], same: bool, done: int, upto: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shards that an anchor visits in turns ``done`` to ``upto``, from the highest bound down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, shards = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
            dims, bucket = batch.column("dims").to_numpy(), batch.column("bucket").to_numpy()
            least = np.array([min(x) for x in batch.column("least").to_pylist()], dtype=np.float64)
            most = np.array([max(x) for x in batch.column("most").to_pylist()], dtype=np.float64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                rows = _matrix(batch.column("vector").take(pa.array(at)), np.int64)
                own = _distances(rows, np.zeros(len(rows)), space.pivots[d])
                keys, near_, far_ = boxes[d]
                near, far = np.zeros((len(at), len(keys))), np.full((len(at), len(keys)), np.inf)
                for p in range(own.shape[1]):
                    of = own[:, p][:, None]
                    np.maximum(near, np.maximum(near_[:, p] - of, of - far_[:, p]), out=near)
                    np.minimum(far, of + far_[:, p], out=far)
                lower, upper = space.bounds(d, (rows.astype(np.float64) ** 2).sum(axis=1)[:, None], near, far)
                if same:
                    upper[keys[:, 0] != bucket[at][:, None]] = -np.inf
                order = np.argsort(-upper, axis=1, kind="stable")[:, done:upto]
                of = lambda x: np.take_along_axis(x, order, axis=1)  # noqa: E731, B023
                q, turn = np.nonzero((of(upper) >= least[at][:, None]) & (of(lower) <= most[at][:, None]))
                picked.append(at[q])
                shards.append(keys[order[q, turn]])
            rows, keys = pa.array(np.concatenate(picked)), np.concatenate(shards)
            columns = [batch.column(c).take(rows) for c in _ASKED if c != "bucket"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32())], names=[*(c for c in _ASKED if c != "bucket"), "bucket", "shard"])

    return run


def _best(asked: DataFrame, shards: DataFrame, space: Space, boxes: dict[int, tuple[np.ndarray, ...]], k: int, same: bool) -> DataFrame:
    """(query, window, vec_id, score, place): the ``k`` best in each window of each anchor, of the same label or of others."""
    place = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id"))
    best, done, n = None, 0, max([len(b[0]) for b in boxes.values()], default=1)
    visit = "query long, label string, vector array<long>, dims int, block int, least array<long>, most array<long>, bucket int, shard int"
    while done < n:
        upto = min(n, max(4, done * 8))
        rows = asked
        if best is not None:
            kth = best.groupBy("query", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where("kth IS NOT NULL")
            kth = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
            rows = rows.join(kth, "query", "left").withColumn("least", F.expr("transform(least, (s, w) -> greatest(s, coalesce(kth[w], s)))"))
        visits = cut(rows.select(*_ASKED).mapInArrow(_visits(space, boxes, same, done, upto), visit))
        if best is not None and visits.isEmpty():
            break
        wanted = visits.select(*[F.col(c).alias(f"_{c}") for c in (*_SHARD, "block")]).distinct()
        sent = shards.join(wanted, [F.col(c) == F.col(f"_{c}") for c in _SHARD]).select(*shards.columns, F.col("_block").alias("block"))
        keys = (*_SHARD, "block")
        found = sent.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_search(space, k, same), _FOUND)
        best = cut((found if best is None else found.unionByName(best.drop("place"))).withColumn("place", place).where(F.col("place") <= k))
        done = upto
    return best


def mine_negatives(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    num: int = 80,
    den: int = 100,
    n_pivots: int = 8,
    shard_rows: int = 8192,
    anchor_block: int = 1024,
    most_shards: int = 65_536,
) -> DataFrame:
    """Rows of other labels that score nearly as high with an anchor as its positives.

    Components count as floor(256 * x), and a score is an integer inner product. Anchors
    are rows whose id ``anchor_every`` divides; an anchor's positives are the first
    ``positives`` other rows of its label, by score from above, ties to the smaller id.
    For each of them the first ``negatives`` rows of other labels are returned that have
    num * positive_score <= den * negative_score <= den * positive_score.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score; fewer rows where there are fewer, none for an anchor without positives.

    Left out: rows with a null id or label, and vectors that are null, empty, or hold a
    null or non-finite component. Rows that repeat an id are rows of their own; only an
    anchor's own row is none for it. Vectors of different lengths have no score. Labels
    are compared as text. Scores times ``den`` must fit 64 bits. Columns of other names
    are ignored. An empty table gives an empty result.

    The driver and each planning task hold the ranges of at most about 1.5 *
    ``most_shards`` shards, 16 * ``n_pivots`` bytes each; a search task holds one shard of about
    max(``shard_rows``, rows / ``most_shards``) vectors and ``anchor_block`` anchors.
    Pivots are chosen from at most 64 * ``n_pivots`` rows of each length.
    """
    label = F.col(label_col).cast("string")
    known = vectors.where(F.col(id_col).isNotNull() & label.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), quantised(F.col(vector_col)).alias("vector"))
    known = cut(known.where("vector IS NOT NULL AND size(vector) > 0").withColumns({"dims": F.size("vector"), "row": F.monotonically_increasing_id()}))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    stats = {r.dims: r for r in known.groupBy("dims").agg(F.max(norm).alias("top"), F.count("*").alias("n")).collect()}
    n = sum(r.n for r in stats.values())
    top = {d: r.top * (1 + 1e-9) for d, r in stats.items()}
    pivots = {d: choose_pivots(_matrix(known.where(F.col("dims") == d).orderBy(F.xxhash64("vector", "row")).limit(64 * n_pivots).select("vector").toArrow().column(0), np.int64), top[d], n_pivots) for d in stats}
    space = Space(pivots, top)
    size = max(shard_rows, -(-n // most_shards))
    bucket = F.pmod(F.xxhash64("label"), F.lit(-(-n // size) or 1)).cast("int").alias("bucket")
    table = cut(known.select("*", bucket).mapInArrow(_pivot_table(space), "vec_id long, label string, vector array<long>, dims int, row long, bucket int, away array<double>, bin long"))
    shards = as_table(pack_bins(table, ["dims", "bucket"], size, "shard").groupBy(*_SHARD).applyInArrow(_as_shard, _SHARD_SCHEMA), "pivots")
    boxes: dict[int, tuple[np.ndarray, ...]] = {}
    ranges = shards.select(*_SHARD, "near", "far").toArrow()
    for d in stats:
        own = ranges.filter(pa.compute.equal(ranges.column("dims"), d))
        keys = np.stack([own.column("bucket").to_numpy(), own.column("shard").to_numpy()], axis=1).astype(np.int64)
        boxes[d] = keys, _matrix(own.column("near"), np.float64), _matrix(own.column("far"), np.float64)
    anchors = pack_bins(table.where(F.col("vec_id") % anchor_every == 0).drop("away"), ["dims"], anchor_block, "block")
    anchors = cut(anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"), "label", "vector", "dims", "bucket", "block"))
    whole = anchors.withColumns({"least": F.array(F.lit(_LOW).cast("long")), "most": F.array(F.lit(_HIGH).cast("long"))})
    near = _best(whole, shards, space, boxes, positives, True).select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    opened = near.groupBy("query").agg(F.array_sort(F.collect_set("positive_score")).alias("most"))
    opened = opened.withColumn("least", F.transform("most", lambda s: F.ceil(s.cast("decimal(38, 0)") * num / den).cast("long")))
    asked = cut(anchors.join(opened, "query"))
    hard = _best(asked, shards, space, boxes, negatives, False)
    hard = hard.join(asked.select("query", "anchor_id", "most"), "query").withColumn("positive_score", F.expr("most[window]"))
    hard = hard.select("query", "anchor_id", "positive_score", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["query", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

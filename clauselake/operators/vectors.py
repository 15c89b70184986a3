"""Exact nearest vectors by cosine without scoring every pair, and an index of vectors on disk.

Vectors are brought to length 1, so a high cosine is a small distance. Rows lie in cells,
each with the one of a bounded number of centres that is nearest. By the triangle
inequality a row's distance from a question is no less than the difference of both
distances from the cell's centre: whole cells are left out where even their nearest row
could not be among the best, and in a cell only the rows whose distance from the centre is
in reach are scored. A question visits its nearest cells first, and all others with the
k-th score found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.sources import tables

Centres = dict[int, np.ndarray]
_SLACK = 1e-9
#: Numbers of a matrix that is made at a time.
PAIRS = 1 << 21


def sound(vector: Column) -> Column:
    """The vector as doubles; null if it is empty, all zeros, or holds a null or a number that is not finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(doubles, lambda x: x != 0)
    return F.when(fine, doubles)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very long vectors would not be finite
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _nearest(centres: np.ndarray, units: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (units @ centres.T)).argmin(axis=1)


def choose_centres(rows: DataFrame, n: int, each: int = 32, steps: int = 5) -> Centres:
    """Up to ``n`` centres for each length of vectors, by k-means over at most ``n`` * ``each`` rows.

    ``rows`` has ``vector`` and ``dims``. Lengths that the sample lacks have no centre; their
    rows are one cell around zero.
    """
    sample = rows.orderBy(F.xxhash64("vector")).limit(n * each).select("vector", "dims").toArrow()
    found: Centres = {}
    for d in sorted(set(sample.column("dims").to_pylist())):
        units = _unit(_matrix(sample.filter(pc.equal(sample.column("dims"), d)).column("vector")))
        centres = units[np.linspace(0, len(units) - 1, min(n, len(units))).astype(np.int64)]
        for _ in range(steps):
            own = _nearest(centres, units)
            centres = np.array([units[own == c].mean(axis=0) for c in np.unique(own)])
        found[d] = centres
    return found


def _into_cells(centres: Centres) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the cell of each row, its distance from the centre, and the vector at length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            ends = np.cumsum(np.append(0, dims))
            unit = np.zeros(ends[-1])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                units = _unit(_matrix(batch.column("vector").take(pa.array(at))))
                middle = centres.get(d, np.zeros((1, d)))
                cell[at] = _nearest(middle, units)
                away[at] = np.sqrt(((units - middle[cell[at]]) ** 2).sum(axis=1))
                unit[ends[at][:, None] + np.arange(d)] = units
            names = [n for n in batch.schema.names if n != "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(unit)), pa.array(cell), pa.array(away)], names=[*names, "vector", "cell", "away"])

    return run


def in_cells(rows: DataFrame, centres: Centres) -> DataFrame:
    """``rows`` (with vector, dims) with cell and away, vectors at length 1."""
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    return rows.mapInArrow(_into_cells(centres), f"{others}, vector array<double>, cell int, away double")


#: For each length and part: cell, nearest and farthest row from its centre, first pack and number of packs.
Cells = dict[tuple[int, str], list[tuple[int, float, float, int, int]]]


def _packed(found: list[Row], task_rows: int) -> tuple[Cells, list[tuple[int, str, int, int, int]]]:
    """Packs of about ``task_rows`` rows: small cells of a part share one, large cells have several."""
    cells: Cells = {}
    n, room, last = 0, 0, None
    for r in sorted(found, key=lambda r: (r.dims, r.part, r.cell)):
        if (r.dims, r.part) != last or r.n > room:
            subs = -(-r.n // task_rows)
            n, room, last = n + subs, subs * task_rows if subs == 1 else 0, (r.dims, r.part)
        else:
            subs = 1
        room -= r.n
        cells.setdefault((r.dims, r.part), []).append((r.cell, r.low, r.high, n - subs, subs))
    return cells, [(d, part, cell, first, subs) for (d, part), own in cells.items() for cell, _, _, first, subs in own]


def _visits(centres: Centres, cells: Cells, done: int, upto: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each pack that a question visits in turns ``done`` to ``upto`` of each part, nearest cells first."""

    def some(batch: pa.RecordBatch, d: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        units = _unit(_matrix(batch.column("vector").take(pa.array(at))))
        middle = centres.get(d, np.zeros((1, d)))
        kth = [dict(x) if x is not None else {} for x in batch.column("kth").take(pa.array(at)).to_pylist()]
        for part in sorted(p for e, p in cells if e == d):
            held, low, high, first, subs = (np.array(x) for x in zip(*cells[d, part], strict=True))
            gap = np.sqrt(np.maximum(0, ((units[:, None] - middle[held]) ** 2).sum(axis=2)))
            least = np.maximum(0, np.maximum(gap - high, low - gap))
            order = np.argsort(least, axis=1, kind="stable")[:, done:upto]
            bound = np.array([k.get(part, -2.0) for k in kth])
            q, turn = np.nonzero(1 - np.take_along_axis(least, order, axis=1) ** 2 / 2 >= bound[:, None] - _SLACK)
            own = order[q, turn]
            of = np.repeat(np.arange(len(own)), subs[own])
            pack = first[own][of] + np.arange(len(of)) - np.repeat(np.cumsum(subs[own]) - subs[own], subs[own])
            q, own = q[of], own[of]
            turn = np.lexsort((own, pack, q))
            q, own, pack = q[turn], own[turn], pack[turn]
            starts = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (pack[1:] != pack[:-1]))) if len(q) else np.zeros(0, np.int64)
            take = pa.array(at[q[starts]])
            visited = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)), pa.int32()), pa.array(held[own], pa.int32()))
            names = ["query_id", "vector", "dims"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in names), pa.array(pack[starts], pa.int32()), visited, pa.array(bound[q[starts]])], names=[*names, "pack", "cells", "kth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {d: max(len(own) for (e, _), own in cells.items() if e == d) for d, _ in cells}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d) if d in most else np.zeros(0, np.int64)
                step = max(1, PAIRS // (d * most.get(d, 1)))
                for done_ in range(0, len(at), step):
                    yield from some(batch, d, at[done_ : done_ + step])

    return run


def _near(units: np.ndarray, questions: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(questions, rows): every pair that may be among the question's best ``k`` of these rows and not under its bar."""
    near = questions @ units.T
    many = np.flatnonzero((near >= bars[:, None] - _SLACK).sum(axis=1) > k)
    bars = bars.copy()
    if len(many):
        bars[many] = np.maximum(bars[many], np.partition(near[many], -k, axis=1)[:, -k])
    return np.nonzero(near >= bars[:, None] - _SLACK)


def _cosines(units: np.ndarray, questions: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row by row, as equal vectors must have equal cosines wherever they lie; a bounded number of pairs at a time."""
    step = max(1, PAIRS // units.shape[1])
    return np.concatenate([np.zeros(0), *((units[at[a : a + step]] * questions[q[a : a + step]]).sum(axis=1) for a in range(0, len(q), step))])


def _leading(q: np.ndarray, place: np.ndarray, cosines: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are the best ``k`` of their question, in its order."""
    order = np.lexsort((place, -cosines, q))
    group = q[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def scan_pack(units: np.ndarray, away: np.ndarray, place: np.ndarray, cell: np.ndarray, questions: np.ndarray, visits: dict[int, np.ndarray], middle: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(questions, rows, cosines, how many pairs were multiplied): the best ``k`` rows of a pack for each question.

    ``visits``: the questions that visit each cell; ``place``: the rows' order among equal
    cosines. Rows under ``kth``, a question's k-th cosine from elsewhere, may be left out.
    Products of matrices tell which pairs can matter, and these alone are scored.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    bars, multiplied = kth.copy(), 0
    for c, asking in visits.items():
        own = np.flatnonzero(cell == c)
        own = own[np.argsort(away[own], kind="stable")]
        gaps = np.sqrt(((questions[asking] - middle[c]) ** 2).sum(axis=1))
        turn = np.argsort(gaps, kind="stable")
        step = max(1, PAIRS // max(1, len(own)))
        for a in range(0, len(turn), step):
            mine, gap = asking[turn[a : a + step]], gaps[turn[a : a + step]]
            reach = np.sqrt(np.maximum(0.0, 2 - 2 * bars[mine])) + 1e-7
            low, high = np.searchsorted(away[own], [(gap - reach).min(), (gap + reach).max() + 1e-12])
            if low == high:
                continue
            rows = own[low:high]
            multiplied += len(rows) * len(mine)
            q, at = _near(units[rows], questions[mine], bars[mine], k)
            q, at = mine[q], rows[at]
            cosines = _cosines(units, questions, q, at)
            keep = _leading(q, place[at], cosines, k)
            keep = keep[cosines[keep] >= bars[q[keep]] - _SLACK]
            q, at, cosines = q[keep], at[keep], cosines[keep]
            found.append((q, at, cosines))
            full = np.flatnonzero(np.bincount(q, minlength=len(bars)) >= k)
            least = np.full(len(bars), np.inf)
            np.minimum.at(least, q, cosines)
            bars[full] = np.maximum(bars[full], least[full])
    q, at, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _leading(q, place[at], cosines, k)
    return q[keep], at[keep], cosines[keep], multiplied


def _scan(centres: Centres, k: int, counter: Accumulator | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        n = at = np.zeros(0, np.int64)
        cosines = np.zeros(0)
        if rows.num_rows and asked.num_rows:
            d = rows.column("dims")[0].as_py()
            place = np.empty(rows.num_rows, np.int64)
            place[pc.sort_indices(rows.column("chunk_id")).to_numpy()] = np.arange(len(place))
            told = asked.column("cells").combine_chunks()
            visited, asking = told.flatten().to_numpy(), pc.list_parent_indices(told).to_numpy()
            visits = {c: asking[visited == c] for c in np.unique(visited).tolist()}
            n, at, cosines, multiplied = scan_pack(_matrix(rows.column("vector")), rows.column("away").to_numpy(), place, rows.column("cell").to_numpy(), _unit(_matrix(asked.column("vector"))), visits, centres.get(d, np.zeros((1, d))), asked.column("kth").to_numpy(), k)
            if counter is not None:
                counter.add(multiplied)
        own, theirs = rows.take(pa.array(at)), asked.take(pa.array(n))
        return pa.table({"query_id": theirs.column("query_id"), "chunk_id": own.column("chunk_id"), "corpus_type": own.column("corpus_type"), "part": own.column("part"), "score": pa.array(cosines, pa.float64())})

    return run


def search_cells(celled: DataFrame, centres: Centres, queries: DataFrame, k: int, *, task_rows: int = 8192, query_block: int = 4096, first_cells: int = 2, counter: Accumulator | None = None) -> DataFrame:
    """(query_id, chunk_id, corpus_type, part, score, rank): the ``k`` best rows of each part for each question.

    ``celled``: (chunk_id, corpus_type, part, dims, vector, cell, away), from ``in_cells``.
    ``queries``: (query_id, vector, dims). Ties go to the smaller chunk_id. About
    ``task_rows`` rows of a pack and ``query_block`` of the questions that visit it meet at a
    time, and there is a partition for each such meeting, so what a task sorts does not
    grow with the tables. The driver holds five numbers for each part and cell and one for
    each pack; parts are few.
    """
    spark = celled.sparkSession
    cells, placed = _packed(celled.groupBy("dims", "part", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).collect(), task_rows)
    put = F.broadcast(spark.createDataFrame(placed, "dims int, part string, cell int, first int, subs int"))
    dealt = celled.join(put, ["dims", "part", "cell"]).withColumn("pack", (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("subs"))).cast("int")).drop("first", "subs")
    asked = tables.written(queries.select("query_id", "vector", "dims"), "asked")
    types = {f.name: f.dataType.simpleString() for f in [*celled.schema, *queries.schema]}
    visit = f"query_id {types['query_id']}, vector array<double>, dims int, pack int, cells array<int>, kth double"
    hit = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, corpus_type string, part string, score double"
    place = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "chunk_id"))
    best, done, most = None, 0, max(map(len, cells.values()), default=1)
    # With many cells a turn in between lifts the bar, so that the last one finds few rows.
    turns = [min(most, first_cells), *([round((first_cells * most) ** 0.5)] if most > 16 * first_cells else []), most]
    for upto in sorted(set(turns)):
        rows = asked.withColumn("kth", F.lit(None).cast("map<string,double>"))
        if best is not None:
            kth = best.groupBy("query_id", "part").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")).where("kth IS NOT NULL")
            rows = tables.written(asked.join(kth.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "kth"))).alias("kth")), "query_id", "left"), "asked")
        visits = rows.mapInArrow(_visits(centres, cells, done, upto), visit)
        blocks = [(r.pack, -(-r.n // query_block)) for r in visits.groupBy("pack").agg(F.count("*").alias("n")).collect()]
        cut = F.broadcast(spark.createDataFrame(blocks, "pack int, blocks int"))
        meetings = sum(n for _, n in blocks)
        # Twice as many partitions as meetings, as hashes put some of them together.
        apart = lambda df: df.repartition(max(1, 2 * meetings), "pack", "block").groupBy("pack", "block")
        sent = dealt.join(cut, "pack").select(*dealt.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        heard = visits.join(cut, "pack").select(*visits.columns, F.pmod(F.xxhash64("query_id", "vector"), F.col("blocks")).cast("int").alias("block"))
        found = apart(sent).cogroup(apart(heard)).applyInArrow(_scan(centres, k, counter), hit)
        best = tables.written((found if best is None else found.unionByName(best.drop("rank"))).withColumn("rank", place).where(F.col("rank") <= k), "best")
        done = upto
    return best


def _prepared(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, sound(F.col("dense")).alias("vector")).where("vector IS NOT NULL").withColumn("dims", F.size("vector"))


def best_cosines(corpus: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), *, cell_rows: int = 4096, most_cells: int = 1024, counter: Accumulator | None = None, **how) -> DataFrame:
    """(query_id, chunk_id, corpus_type, score, rank): the ``k`` best of each question, or with corpus_type in ``by`` of each question and corpus.

    ``corpus``: (chunk_id, corpus_type, dense); ``queries``: (query_id, dense). A row has a
    cosine with questions of its own length only; vectors that are null, zero or not finite
    have none. Cells are made for this search; ``VectorIndex`` keeps them.
    """
    part = F.col("corpus_type") if "corpus_type" in by else F.lit("")
    rows = tables.written(_prepared(corpus.withColumn("part", F.coalesce(part, F.lit(""))), "chunk_id", "corpus_type", "part"), "rows")
    centres = choose_centres(rows, max(1, min(most_cells, -(-rows.count() // cell_rows))))
    celled = tables.written(in_cells(rows, centres), "cells")
    return search_cells(celled, centres, _prepared(queries, "query_id"), k, counter=counter, **how).drop("part")


# ------------------------------------------------------------------------ the index on disk


class VectorIndex:
    """A collection of vectors as Parquet, partitioned by corpus and cell.

    Rows: chunk_id (the key), corpus_type, status, dense. The centres are chosen when the
    collection is made and stay; rows that come later go to the nearest of them. Writing
    replaces the partitions that hold or get a key of the write and no others. A
    partition that loses its last row keeps one without a key, which no reader sees.
    """

    COLUMNS = ("chunk_id", "corpus_type", "status", "dense")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        kept = spark.read.parquet(f"{path}/centres").orderBy("dims", "cell").toArrow()
        self.centres: Centres = {d: _matrix(kept.filter(pc.equal(kept.column("dims"), d)).column("centre")) for d in sorted(set(kept.column("dims").to_pylist()))}

    @classmethod
    def create(cls, path: str, rows: DataFrame, *, cell_rows: int = 4096, most_cells: int = 1024) -> VectorIndex:
        """Makes the collection from its first rows; of rows that share a key one is kept, of the greatest vector."""
        spark = rows.sparkSession
        first = _prepared(rows, "chunk_id", "corpus_type", "status")
        centres = choose_centres(first, max(1, min(most_cells, -(-first.count() // cell_rows))))
        told = [(d, c, row.tolist()) for d, own in centres.items() for c, row in enumerate(own)]
        spark.createDataFrame(told, "dims int, cell int, centre array<double>").write.parquet(f"{path}/centres")
        index = cls(spark, path)
        index._placed(rows).write.partitionBy("corpus_type", "cell").parquet(f"{path}/rows")
        return index

    def _placed(self, rows: DataFrame) -> DataFrame:
        one = rows.where("chunk_id IS NOT NULL AND corpus_type IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct("corpus_type", "status", "dense"), "dense").alias("_r")).select("chunk_id", "_r.*")
        return in_cells(_prepared(one, "chunk_id", "corpus_type", "status"), self.centres)

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._all().where("chunk_id IS NOT NULL")

    def _replace(self, keys: DataFrame, fresh: DataFrame | None) -> None:
        """Takes the keys out of the partitions that hold them, and puts ``fresh`` in."""
        old = self.rows()
        touched = old.join(keys, "chunk_id", "left_semi").select("corpus_type", "cell").distinct()
        if fresh is not None:
            touched = touched.union(fresh.select("corpus_type", "cell")).distinct()
        touched = tables.written(touched, "touched")
        kept = old.join(touched, ["corpus_type", "cell"], "left_semi").join(keys, "chunk_id", "left_anti")
        after = tables.written(kept if fresh is None else kept.unionByName(fresh), "after")
        left = touched.join(after.select("corpus_type", "cell").distinct(), ["corpus_type", "cell"], "left_anti")
        tables.replace_partitions(after.unionByName(left, allowMissingColumns=True), f"{self.path}/rows", "corpus_type", "cell")
        self.spark.catalog.refreshByPath(f"{self.path}/rows")

    def upsert(self, rows: DataFrame) -> None:
        """Puts rows in, in place of those with their keys."""
        fresh = tables.written(self._placed(rows), "fresh")
        # A key whose new vector is of no use goes as well.
        self._replace(tables.written(rows.select("chunk_id").where("chunk_id IS NOT NULL").distinct(), "keys"), fresh)

    def delete(self, keys: DataFrame) -> None:
        self._replace(tables.written(keys.select("chunk_id").distinct(), "keys"), None)

    def describe(self) -> DataFrame:
        """(corpus_type, status, rows, cells): what the collection's partitions hold."""
        return self.rows().groupBy("corpus_type", "status").agg(F.count("*").alias("rows"), F.countDistinct("cell").alias("cells"))

    def search(self, queries: DataFrame, k: int, *, statuses: tuple[str, ...] = ("effective",), counter: Accumulator | None = None, **how) -> DataFrame:
        """(query_id, chunk_id, corpus_type, score, rank): the ``k`` best of each corpus for each question (query_id, dense)."""
        shown = self.rows().where(F.col("status").isin(*statuses)).withColumn("part", F.col("corpus_type"))
        return search_cells(shown.drop("status"), self.centres, _prepared(queries, "query_id"), k, counter=counter, **how).drop("part")

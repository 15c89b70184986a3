"""Nearest vectors against brute force, and the index on disk."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from clauselake.operators import vectors
from clauselake.operators.vectors import VectorIndex, best_cosines

SCHEMA = "chunk_id long, corpus_type string, status string, dense array<double>"


def brute_force(corpus, queries, k, by_corpus=True):
    out = []
    length = lambda v: math.sqrt(sum(x * x for x in v))
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for q, v in queries:
        scored = {}
        for i, kind, _, w in corpus:
            if fine(v) and fine(w) and len(v) == len(w):
                scored.setdefault(kind if by_corpus else "", []).append((-round(sum(a * b for a, b in zip(v, w, strict=True)) / length(v) / length(w), 9), i))
        out += [(q, i, n + 1, -s) for rows in scored.values() for n, (s, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def result(found):
    return sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9) + 0.0) for r in found.collect())


def clustered(n, dims=8, centres=40, seed=1, spread=0.03):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, draw.choice(["A", "A", "B"]), "effective", [c + draw.gauss(0, spread) for c in draw.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [16, 100_000])
def test_against_brute_force(spark, cell_rows):
    rows = clustered(400)
    rows += [(1000 + j, "A", "effective", rows[5][3]) for j in range(30)]  # ties
    rows += [(2000, "A", "effective", None), (2001, "A", "effective", []), (2002, "A", "effective", [0.0] * 8), (2003, "B", "effective", [float("nan")] + [1.0] * 7), (2004, "B", "effective", [None] + [1.0] * 7), (2005, "B", "effective", [1e300] * 8)]
    rows += [(3000 + k, "B", "effective", [1.0, float(k)]) for k in range(7)]  # another length
    queries = [(i, v) for i, _, _, v in rows[::9]] + [(9001, None), (9002, [0.0] * 8), (9003, [1.0, 1.0]), (9004, [1.0])]
    corpus = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, dense array<double>")
    for by, grouped in ((("query_id", "corpus_type"), True), (("query_id",), False)):
        got = best_cosines(corpus, asked, 7, by, cell_rows=cell_rows, task_rows=64, query_block=16)
        want = brute_force([(i, c, s, [x / 1e300 for x in v] if i == 2005 else v) for i, c, s, v in rows], [(q, [x / 1e300 for x in v] if q == 2005 else v) for q, v in queries], 7, grouped)
        assert result(got) == want


def test_few_pairs_are_scored_in_clusters(spark):
    rows = clustered(4000)
    corpus = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(i, v) for i, _, _, v in rows[::20]], "query_id long, dense array<double>")
    counter = spark.sparkContext.accumulator(0)
    got = result(best_cosines(corpus, queries, 25, ("query_id", "corpus_type"), cell_rows=100, counter=counter))
    assert got == brute_force(rows, [(i, v) for i, _, _, v in rows[::20]], 25)
    assert 0 < counter.value < 4000 * 200 / 4


def test_visits_are_made_in_pieces_and_packs():
    draw = np.random.default_rng(3)
    n, d = 3000, 64
    middle = draw.normal(size=(400, d)) / 16
    stats = [Row(dims=d, part=p, cell=c, low=0.0, high=1.0, n=900 if c == 5 else 90) for p in "ab" for c in range(400)]
    cells, placed = vectors._packed(stats, 400)
    sizes = {}
    for _, part, c, first, subs in placed:
        assert subs == (3 if c == 5 else 1)
        for pack in range(first, first + subs):
            sizes.setdefault(pack, []).append((part, 900 / subs if c == 5 else 90))
    assert sorted(sizes) == list(range(len(sizes))) and all(len({p for p, _ in own}) == 1 and sum(m for _, m in own) <= 400 for own in sizes.values())
    batch = pa.RecordBatch.from_pydict({"query_id": range(n), "vector": pa.array(list(draw.normal(size=(n, d)))), "dims": pa.array([d] * n, pa.int32()), "kth": pa.array([None] * n, pa.map_(pa.string(), pa.float64()))})
    tracemalloc.start()
    told, largest = {}, 0
    for part in vectors._visits(dict([(d, middle)]), cells, 3, 8)(iter([batch])):
        largest = max(largest, part.num_rows)
        for r in part.select(["query_id", "pack", "cells"]).to_pylist():
            told.setdefault(r["query_id"], []).extend((r["pack"], c) for c in r["cells"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and largest < n
    own = {(c, part): range(first, first + subs) for _, part, c, first, subs in placed}
    assert len(told) == n
    for seen in told.values():
        assert len(seen) == len(set(seen)) and len({(c, p) for (c, p), packs in own.items() for pack, v in seen if v == c and pack in packs}) == 10
        assert all((pack, c) in seen for (c, p), packs in own.items() if any((k, c) in seen for k in packs) for pack in packs)


def test_index_takes_rows_in_and_out(spark, tmp_path):
    rows = clustered(300)
    path = str(tmp_path / "index")
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    index = VectorIndex.create(path, frame(rows + [(7, "A", "effective", [0.0] * 8)]), cell_rows=20)
    queries = [(i, v) for i, _, _, v in rows[::11]]
    asked = spark.createDataFrame(queries, "query_id long, dense array<double>")
    held = {r[0]: r for r in rows}
    assert result(index.search(asked, 5)) == brute_force(held.values(), queries, 5)
    fresh = [(3, "B", "effective", rows[10][3]), (4, "A", "superseded", rows[4][3]), (900, "C", "effective", rows[9][3]), (5, "A", "effective", None)]
    index.upsert(frame(fresh))
    held |= {r[0]: r for r in fresh}
    del held[5]
    shown = [r for r in held.values() if r[2] == "effective"]
    assert result(VectorIndex(spark, path).search(asked, 5)) == brute_force(shown, queries, 5)
    index.delete(frame([held[900], held[8]]))
    for gone in (900, 8):
        del held[gone]
    shown = [r for r in held.values() if r[2] == "effective"]
    assert result(index.search(asked, 5)) == brute_force(shown, queries, 5)
    assert result(index.search(asked, 5, statuses=("effective", "superseded"))) == brute_force(held.values(), queries, 5)
    told = {(r.corpus_type, r.status): r.rows for r in index.describe().collect()}
    assert sum(told.values()) == len(held) and ("C", "effective") not in told and told["A", "superseded"] == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, dense array<double>")
    assert best_cosines(empty, asked, 3).count() == 0
    assert best_cosines(spark.createDataFrame([(1, "A", "effective", [1.0])], SCHEMA), asked.limit(0), 3).count() == 0

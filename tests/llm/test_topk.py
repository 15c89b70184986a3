import math
import random

from clauselake.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, shard int"


def brute_force(rows, every, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(sound):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for n, (j, p) in enumerate(sound) if n != at and len(p) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [round(c + draw.gauss(0, 0.2), 3) for c in draw.choice(centres)]) for i in range(-50, 700)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(1000 + j, rows[7][1]) for j in range(40)]  # ties
    rows += [(None, rows[0][1]), (2000, None), (2010, []), (2020, [1.0, None] * 4), (2030, [float("nan")] * 8), (2040, [float("inf")] * 8), (2050, [1.0, 2.0]), (5, rows[9][1]), (10, rows[11][1]), (10, rows[11][1])]
    import numpy as np

    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in as_float], SCHEMA)
    for shard_rows, block, cells in ((64, 16, 256), (32, 16, 3), (8192, 4096, 256)):
        got = sorted(map(tuple, exact_top_k(frame, query_every=10, k=5, shard_rows=shard_rows, query_block=block, most_cells=cells).collect()))
        assert got == brute_force(as_float, 10, 5)


def test_fewer_candidates_and_empty(spark):
    assert exact_top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    got = exact_top_k(spark.createDataFrame([(0, [1.0], 0, 0), (1, [2.0], 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 512)]


def test_rows_that_repeat_an_id_are_candidates(spark):
    got = exact_top_k(spark.createDataFrame([(0, [1.0], 0, 0), (1, [2.0], 0, 0), (1, [3.0], 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 768), (0, 2, 1, 256 * 512)]

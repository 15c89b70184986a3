import math
import random

import numpy as np

from clauselake.llm.hard_negatives import Space, Windows, choose_pivots, mine_negatives, search_shard

SCHEMA = "vec_id long, embedding array<float>, label int, row int, query string"


def brute_force(rows, every, positives, negatives, num=80, den=100):
    sound = [(i, [math.floor(256 * x) for x in v], str(c)) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q, c) in enumerate(sound):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, d) for n, (j, p, d) in enumerate(sound) if n != at and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [x for x in scored if x[2] != c and num * -s <= den * -x[0] <= den * -s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fit[:negatives])]
    return sorted(out)


def result(frame, **options):
    return sorted(tuple(r) for r in mine_negatives(frame, **options).collect())


def clustered(draw, n, dims=8, centres=6, spread=0.2):
    middle = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [float(np.float32(c + draw.gauss(0, spread))) for c in draw.choice(middle)], draw.choice([0, 1, 1, 1, 2, 3])) for i in range(n)]


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = clustered(draw, 600)
    rows += [(1000 + j, rows[7][1], j % 2) for j in range(40)]  # ties
    rows += [(10, rows[11][1], 1), (10, rows[11][1], 1), (5, rows[9][1], 2)]  # repeated ids
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2010, [], 1), (2020, [1.0, None] * 4, 1), (2030, [float("nan")] * 8, 1), (2040, [float("inf")] * 8, 0), (2050, rows[3][1], None)]
    rows += [(2060 + k, [1.0 + k, 2.0], k % 2) for k in range(9)]  # another length
    rows += [(3000, [0.0] * 8, 1), (3001, [0.0] * 8, 0), (3010, [1.0, 0.0, 0.0], 7)]
    frame = spark.createDataFrame([(i, v, c, 1, "clash") for i, v, c in rows], SCHEMA).repartition(3)
    for options in ({"shard_rows": 8192}, {"shard_rows": 24, "anchor_block": 5, "n_pivots": 4}, {"shard_rows": 100, "most_shards": 2, "n_pivots": 1}):
        assert result(frame, anchor_every=10, positives=5, negatives=5, **options) == brute_force(rows, 10, 5, 5)
    assert result(frame, anchor_every=30, positives=2, negatives=7, num=50, shard_rows=64) == brute_force(rows, 30, 2, 7, 50)


def test_brackets_leave_most_rows_unscored():
    draw = random.Random(8)
    rows = clustered(draw, 4000, dims=6, centres=12, spread=0.05)
    vectors = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows])
    top = float((vectors**2).sum(axis=1).max()) * (1 + 1e-9)
    space = Space({6: choose_pivots(vectors[:512], top, 8)}, {6: top})
    from clauselake.llm.hard_negatives import _added, _distances

    away = _distances(vectors, _added(vectors, top), space.pivots[6])
    order = np.argsort(away[:, 0])
    shard = {"rows": order, "ids": order, "labels": np.array(["0"] * len(order), dtype=object), "vectors": vectors[order], "table": away[order].T}
    scored = [search_shard(space, 6, shard, q, "0", vectors[q], Windows([-(1 << 62)], [1 << 62], 5), True) for q in range(0, 4000, 100)]
    assert sum(scored) < len(scored) * 4000 / 2


def test_empty_and_few(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    one = spark.createDataFrame([(0, [1.0], 1, 0, ""), (1, [1.0], 1, 0, ""), (2, [0.9], 2, 0, "")], SCHEMA)
    assert result(one) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert result(one.where("vec_id <> 1")) == []

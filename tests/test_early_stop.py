"""Sparse search that stops early, and containment as an equi-join, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import containment, curation, retrieval, routing
from clauselake.operators.postings import build_index, sparse_best

POSTINGS = "token string, chunk_id long, corpus_type string, weight double"


def best_sums(rows, questions, k, shown=None):
    weights = {}
    for token, chunk, kind, w in rows:
        if token is not None and w is not None and w > 0:
            weights[token, chunk, kind] = weights.get((token, chunk, kind), 0) + w
    out = []
    for q, sparse in questions:
        sums = {}
        for (token, chunk, kind), w in weights.items():
            if (sparse.get(token) or 0) > 0 and (shown is None or chunk in shown):
                sums.setdefault(kind, {}).setdefault(chunk, 0)
                sums[kind][chunk] += w * sparse[token]
        out += [(q, kind, chunk, n + 1, s) for kind, own in sums.items() for n, (chunk, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    rows = [(f"t{min(39, int(draw.paretovariate(0.6)))}", draw.randrange(n), None, round(draw.paretovariate(1.1) * 4) / 4) for _ in range(8 * n)]
    return [(t, c, "AB"[c % 3 == 0], w) for t, c, _, w in rows] + [(None, 1, "A", 1.0), ("t1", 2, "A", None), ("t1", 2, "A", 0.0), ("t1", 4, "A", -1.0)]


@pytest.mark.parametrize(("block", "part"), [(4, 1000), (16, 20), (1000, 1000)])
def test_best_sums(spark, block, part):
    rows = corpus(3, 120)
    draw = random.Random(9)
    questions = [(q, {f"t{draw.randrange(45)}": draw.choice([0.25, 0.5, 1.0, 3.0]) for _ in range(draw.randrange(1, 6))}) for q in range(25)] + [(90, {"none": 1.0}), (91, {"t1": 0.0}), (92, {})]
    index = build_index(spark.createDataFrame(rows, POSTINGS).repartition(3), block_rows=block, part_rows=part)
    asked = spark.createDataFrame(questions, "query_id long, sparse map<string,double>")
    got = lambda found: sorted((r.query_id, r.corpus_type, r.chunk_id, r["rank"], r.score) for r in found.collect())
    assert got(sparse_best(index, asked, 5)) == best_sums(rows, questions, 5)
    shown = set(range(0, 120, 2))
    some = spark.createDataFrame([(c,) for c in shown], "chunk_id long")
    assert got(sparse_best(index, asked, 5, some)) == best_sums(rows, questions, 5, shown)


def test_most_blocks_are_never_read(spark):
    draw = random.Random(1)
    rows = [("t0", c, "A", 100.0 / (c + 1)) for c in range(3000)] + [("t1", c, "A", 1.0 + draw.random()) for c in range(0, 3000, 7)]
    index = build_index(spark.createDataFrame(rows, POSTINGS), block_rows=32)
    asked = spark.createDataFrame([(1, {"t0": 1.0, "t1": 1.0}), (2, {"t0": 2.0})], "query_id long, sparse map<string,double>")
    tally = []
    found = sparse_best(index, asked, 10, tally=tally)
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(q, c) for q, _, c, _, _ in best_sums(rows, [(1, {"t0": 1.0, "t1": 1.0}), (2, {"t0": 2.0})], 10)}
    assert sum(tally) < index.blocks.count() / 2


def test_empty_index(spark):
    index = build_index(spark.createDataFrame([], POSTINGS))
    assert sparse_best(index, spark.createDataFrame([(1, {"a": 1.0})], "query_id long, sparse map<string,double>"), 3).count() == 0


def test_hybrid_with_either_form_of_postings(spark):
    draw = random.Random(5)
    vectors = spark.createDataFrame([(c, "P-INT", "effective", [draw.gauss(0, 1) for _ in range(4)]) for c in range(60)], "chunk_id long, corpus_type string, status string, dense array<double>")
    postings = spark.createDataFrame([(f"t{draw.randrange(9)}", c, "P-INT", float(draw.randrange(1, 9))) for c in range(60) for _ in range(3)], POSTINGS)
    queries = vectors.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "dense", F.create_map(F.lit("t1"), F.lit(1.0), F.lit("t4"), F.lit(0.5)).alias("sparse"))
    rows = lambda how: sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in retrieval.search(vectors, how, queries, 9, 6).collect())
    assert rows(postings) == rows(build_index(postings, block_rows=4))


@pytest.mark.parametrize("q", [1, 2, 3])
def test_holding(spark, q):
    draw = random.Random(q)
    texts = ["".join(draw.choices("abc証券法 ", k=draw.randrange(12))) for _ in range(80)] + ["", None, "aaaa"]
    terms = ["".join(draw.choices("abc証券法", k=draw.randrange(1, 5))) for _ in range(40)] + ["", None, "aa", "aa", "a", "法"]
    found = containment.holding(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame(list(enumerate(terms)), "j int, term string"), "text", "term", q)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert sorted((r.i, r.j) for r in found.collect()) == [(i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if t is not None and w and w in t]
    none = spark.createDataFrame([], "j int, term string")
    assert containment.holding(spark.createDataFrame([(1, "a")], "i int, text string"), none, "text", "term", q).count() == 0


def test_no_nested_loops_where_dictionaries_are_looked_up(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    plans = [
        routing.terms_in(frame([(1, "a b")], "query_id int, question string"), frame([(0, "b")], "ord int, term string")),
        retrieval.legal_terms(frame([(1, "a b")], "query_id int, question string"), frame([(0, "b", ["c"])], "ord int, oral_term string, legal_terms array<string>")),
        curation.cited(frame([("x title",)], "title string"), frame([("title",), ("an x title",)], "title string"), frame([("1号",)], "doc_number string")),
    ]
    for plan in plans:
        assert "NestedLoop" not in plan._jdf.queryExecution().toString() and plan.count() == 1

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clauselake.llm.common import fold_of
from clauselake.llm import quality
from clauselake.llm.quality import fit_ranker, learn_quality, score_quality

SF = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranker = learn_quality(docs, labels)
    got = score_quality(docs, ranker).join(labels, "doc_id").where(fold_of(F.col("doc_id"), 4) == 2).collect()
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert np.mean([r.predicted == r.quality for r in got]) > 0.85
    assert all(0 <= r.score <= 1 for r in got)


def test_pairs_order_documents():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 6)).astype(np.float32)
    y = (x @ np.array([2, -1, 0, 0, 0.5, 0]) + draw.normal(size=400) * 0.1 > 0).astype(int)
    s = fit_ranker(x, y, 0.7).scores(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.98
    assert abs((s >= 0.7).mean() - y.mean()) < 0.02  # the cut is the score quantile at the share of label 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "abc", 0.5), (3, "w " * 300_000, 0.5), (3, "w", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranker = learn_quality(docs, none)
    got = score_quality(docs, ranker, carry=("score",)).collect()
    assert len(got) == 5 and all(r.score == 1.0 and r.carried.score == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, learn_quality(docs, one, folds=1, held_out_fold=9)).count() == 5
    assert score_quality(spark.createDataFrame([], docs.schema), ranker).count() == 0


def test_carried_texts_go_to_the_workers_once(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.union(spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "x", 0)], docs.schema))
    ranker = learn_quality(docs, labels)
    got = score_quality(docs, ranker, carry=docs.columns)
    assert "_text" not in got._jdf.queryExecution().optimizedPlan().toString()
    told = lambda df: sorted((str(r[0]), round(r[1], 9), r[2]) for r in df.collect())
    assert told(got.select("carried.doc_id", "score", "predicted")) == told(score_quality(docs, ranker))
    assert got.where("NOT doc_id <=> carried.doc_id").count() == 0
    batch = pa.RecordBatch.from_pydict({"_text": [str(k) for k in range(2 * quality.ROWS + 1)]})
    assert [p.num_rows for p in quality._parts(iter([batch]))] == [quality.ROWS, quality.ROWS, 1]

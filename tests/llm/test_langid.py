from pyspark.sql import functions as F

from clauselake.llm.common import fold_of
from clauselake.llm.langid import identify_languages, learn_languages

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    model = learn_languages(docs, folds=5, held_out_fold=0)
    got = identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold_of(F.col("doc_id"), 5) == 0).where("lang IS NOT NULL").collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right > 0.9, right
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark):
    docs = spark.read.parquet(SF)
    model = learn_languages(docs)
    rows = [(1, None, 0), (2, "", 0), (3, "123 !?", 0), (None, "la casa es grande y bonita", 0), (5, "word " * 200_000, 0), (5, "word", 0)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang_pred int"), model).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len(got) == 6


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn_languages(empty)
    assert identify_languages(empty, model).count() == 0
    assert identify_languages(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_outliers_are_rejected(spark):
    docs = spark.read.parquet(SF)
    model = learn_languages(docs)
    strange = spark.createDataFrame([(1, "qqqq zzzz xxxx " * 40), (2, docs.where("lang IS NOT NULL AND length(text) > 400").first().text)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in identify_languages(strange, model).collect()}
    assert got[1] and not got[2]

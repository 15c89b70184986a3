import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from clauselake.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_stages_keep_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        seen = kept.count()
        assert 0 < seen
        if name != "mixing sources to target weights":
            assert seen <= docs.count()
        docs = kept.checkpoint()
    final = P.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count() and {"shard", "slot", "text"} <= set(final.columns)


def test_near_duplicates_leave_one(spark):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    base = [draw.choice(words) for _ in range(120)]
    near = base[:60] + ["new"] + base[61:]
    rows = [(7, " ".join(base)), (3, " ".join(base)), (5, " ".join(near)), (9, "something else entirely here now ok"), (None, "alone as can be in this text"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {3, 9, None, 11, 12}


def test_contaminated_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, f"before it {item} and after"), (2, "clean text of no matter"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in P.drop_contaminated(spark, docs, SF).collect()} == {2, 3}


@pytest.mark.parametrize("rows", [0, 200])
def test_run(spark, rows, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{SF}/{name}.parquet")
        (frame.limit(0) if rows == 0 and name == "documents" else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, str(tmp_path))
    got = out.collect()
    assert (len(got) > 0) == (rows > 0)
    slots = Counter((r.shard, r.slot) for r in got)
    assert all(n == 1 for n in slots.values())
    if rows:
        assert out.where(F.col("text").isNull() & (F.col("size") != 16)).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_near(pairs):
    """The distinct (id, text) pairs that stay; of each class those of smallest id."""
    pairs = sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    sets = [shingles(t, 5) for _, t in pairs]
    label = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return {pairs[k] for k in range(len(pairs)) if label[k] == k}


def test_texts_of_one_id_are_decided_apart(spark):
    draw = random.Random(3)
    text = lambda: " ".join(draw.choice([f"w{k}" for k in range(200)]) for _ in range(60))
    t = [text() for _ in range(9)]
    rows = [(5, t[0]), (5, t[1]), (3, t[0]), (8, t[2]), (8, t[3]), (8, t[3]), (9, t[4] + " more"), (9, t[5]), (12, t[4]), (20, None), (20, t[6]), (None, t[7]), (7, t[7]), (7, t[8]), (30, "alone"), (30, "alone")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows)
    assert {(5, t[1]), (3, t[0]), (8, t[2]), (8, t[3]), (20, None), (20, t[6]), (7, t[8])} <= set(got)


def test_run_against_brute_force(spark, tmp_path):
    """run() over repeated ids; only the ranking and the copies are taken from their stages."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("doc_id", F.col("doc_id") % 60).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {(r.doc_id, r.text) for r in P.keep_quality(spark, docs, str(tmp_path)).collect()}
    items = set().union(*(shingles(r.text, 10) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    kept = {(i, x) for i, x in brute_near(left) if not {g for g in shingles(x, 10) if len(g) == 10} & items}
    whole = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.distinct().collect() if (r.doc_id, r.text) in kept], docs.schema)
    want = Counter((r.doc_id, r.text) for r in P.mix_sources(spark, whole, str(tmp_path)).collect())
    assert set(want) <= kept
    got = Counter((r.doc_id, r.text) for r in P.run(spark, str(tmp_path)).collect())
    assert set(got) <= kept and abs(sum(got.values()) - sum(want.values())) <= 0.05 * sum(want.values())
    assert len(set(got) ^ set(want)) <= 0.05 * len(want)


def test_clashing_columns_and_null_ids(spark):
    rows = [(-1, "a b c d e f", 5), (None, "a b c d e f g h i j k l m n o p", 6), (None, "other words are here", 7), (None, "other words are here", 8), (P.OWN_KEYS - 5, "one two three", 9), (-7, None, 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").selectExpr("*", "size AS shard", "size AS doc_size", "'s' AS source")
    kept = P.drop_near_duplicates(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t, n in rows if n != 8)
    final = P.shard(spark, docs, SF)
    assert {"size", "shard", "doc_size", "doc_doc_size", "doc_shard", "source", "text"} <= set(final.columns)
    assert sorted(r.doc_doc_size for r in final.collect()) == sorted(n for _, _, n in rows)

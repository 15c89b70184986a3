"""What holds for larger tables than those of the tests: ids that meet, joins that must not broadcast."""

import re

import duckdb
from pyspark.sql import functions as F

from clauselake.operators import alignment, containment, products, references, retrieval, structure, vectors
from clauselake.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_added_rows_meet_ids_of_parts(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame([(k, f"name {k}", f"brand {k}") for k in (5, 6, 10, 1000005, 1000006, 1000010)], "p_partkey long, p_name string, p_brand string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/*.parquet'")
    found = catalog.QUERIES["table_upsert"](spark, str(tmp_path)).select("id", "name").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(catalog.ORACLE_SQL["table_upsert"]).fetchall())


def test_citations_are_aligned_without_broadcasts(spark, tmp_path):
    path = str(tmp_path / "versions")
    spark.createDataFrame([(1, "n1", "t1"), (2, None, "t2"), (3, "n1", "t3")], "version_id long, doc_number string, title string").write.parquet(path)
    versions = spark.read.parquet(path).select("*", F.lit("effective").alias("version_status"), F.lit("P-EXT").alias("corpus_type"))
    chunks = versions.select("version_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select("version_id", F.concat(F.lit("1/"), F.col("n").cast("string")).alias("clause_path_norm"))
    rows = [(1, 1, "t1", "n1", "第2条"), (1, 2, "t2", None, "第9条"), (1, 3, "t3", "n9", None), (2, 1, "n1", None, "第1条"), (2, 2, None, None, None)]
    found = references.align_citations(spark.createDataFrame(rows, "case_id long, ord int, title string, doc_number string, clause string"), versions, chunks)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "n1", "t1", "1/2", True), (1, 2, None, "t2", None, False), (1, 3, "n1", "t3", None, True), (2, 1, None, "n1", None, False), (2, 2, None, None, None, False)]
    assert "Broadcast" not in plan(found)


def test_cited_clauses_are_found_without_broadcasts(spark, tmp_path):
    path = str(tmp_path / "versions")
    spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n1")], "version_id long, doc_number string").write.parquet(path)
    versions = spark.read.parquet(path).withColumn("version_status", F.lit("effective"))
    chunks = versions.select("version_id", F.explode(F.array(*map(F.lit, "123"))).alias("clause_path_norm")).select("*", F.concat_ws("/", "version_id", "clause_path_norm").alias("chunk_id"), F.lit(0).alias("seq"), F.lit(False).alias("is_parent"), F.lit(False).alias("degraded"))
    entry = "array<struct<doc_no:string,clause_path_norm:string>>"
    cases = spark.createDataFrame([(1, [("n1", "2"), ("n1", "2"), ("n9", "1")]), (2, [("n2", "3"), ("n2", "4"), ("n2", None)])], f"case_id long, cited_regulations {entry}")
    found = references.cited_clauses(cases, versions, chunks)
    assert sorted(map(tuple, found.collect())) == [(1, "n1|2", "1/2"), (2, "n2|3", "2/3")]
    assert "Broadcast" not in plan(found)


def test_sparse_sums_are_made_in_bounded_blocks(spark, monkeypatch):
    rows = [(f"t{t}", c, "ab"[c % 2], float((t * c) % 5) if (t + c) % 11 else None) for c in range(60) for t in range(9) if (t * 7 + c) % 3 == 0]
    told = [(q, {f"t{t}": float(1 + (q + t) % 3) for t in range(q % 4, 9, 2)}) for q in (1, 2, 3, 4, 5, 5)]
    postings = spark.createDataFrame([*rows, rows[0]], "token string, chunk_id long, corpus_type string, weight double")
    queries = spark.createDataFrame(told, "query_id long, sparse map<string,double>")
    want = {}
    for q, sparse in told:
        for token, c, kind, weight in [*rows, rows[0]]:
            if token in sparse:
                old = want.setdefault((q, c, kind), None)
                want[q, c, kind] = old if weight is None else (old or 0.0) + weight * sparse[token]
    monkeypatch.setattr(products, "PAIRS", 40)
    got = lambda df: {tuple(r)[:3]: r.score for r in df.collect()}
    for how in ({}, {"chunk_block": 20, "query_block": 8}):
        assert got(products.sums(postings, queries, **how)) == want
    best = retrieval.best(products.sums(postings, queries, 4, chunk_block=20, query_block=8), 4, ("query_id", "corpus_type"))
    told_best = {}
    for (q, c, kind), score in want.items():
        told_best.setdefault((q, kind), []).append((score is None, -(score or 0), c))
    assert {tuple(r)[:3] for r in best.select("query_id", "chunk_id", "corpus_type").collect()} == {(q, c, kind) for (q, kind), all_ in told_best.items() for _, _, c in sorted(all_)[:4]}
    assert products.sums(postings.limit(0), queries, 4).count() == 0
    assert "HashAggregate" not in plan(retrieval.sparse_scores(postings, queries))


def test_a_changed_block_is_not_taken_for_its_copy_far_behind(spark):
    lines = [f"{'甲乙丙丁戊己庚辛壬癸'[k % 10]}{'春夏秋'[k % 3]} the very same words stand on every single line of this text, again and again" for k in range(100)]
    text = [t[:30] + "¤" + t[31:] if k in (2, 17, 41) else t for k, t in enumerate(lines)]
    pages = [(1, n + 1, "\n".join(text[n * 5 : n * 5 + 5])) for n in range(20)]
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "version_id long, idx int, text string").withColumns({"page": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
    found = alignment.align_pages(blocks, spark.createDataFrame(pages, "version_id long, page_no int, text string"))
    assert {r.idx: (r.page, r.page_end) for r in found.collect()} == {k: (k // 5 + 1, None) for k in range(100)}


def test_spans_run_the_pattern_once(spark):
    texts = ["见第三条和前条", "第三条第三条之一本办法本条", "", None, "前条前前条 本条", "《甲》《甲乙》第一条", "𠀀前款𠀀前二款"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", references.spans(F.col("t"), references._ANY).alias("s"))
    for r in found.collect():
        assert [tuple(x) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(references._ANY, r.t or "")]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1 and "split(" not in text


def test_candidates_are_scored_by_blocks(spark):
    for name in ("search_candidates", "verify_smoke"):
        text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "FlatMapCoGroupsInArrow" in text and not re.search(r"sum\(\(?weight", text)


def test_partitions_of_a_search_follow_what_meets(spark, monkeypatch):
    rows = [(k, "ab"[k % 2], [float(k % 7), float(k % 11), 1.0 + k % 3]) for k in range(300)]
    corpus = spark.createDataFrame(rows, "chunk_id long, corpus_type string, dense array<double>")
    queries = corpus.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), "dense")
    found, written = [], vectors.tables.written
    monkeypatch.setattr(vectors.tables, "written", lambda df, name: found.append((name, plan(df))) or written(df, name))
    vectors.best_cosines(corpus, queries, 3, ("query_id", "corpus_type"), cell_rows=1000, task_rows=50, query_block=10)
    # Two parts of three packs, and six blocks of ten questions for each.
    assert [set(re.findall(r"hashpartitioning\(pack#\d+, block#\d+, (\d+)\)", text)) for name, text in found if name == "best"] == [{"72"}]
    postings = spark.createDataFrame([(f"t{c % 5}", c, "a", 1.0) for c in range(200)], "token string, chunk_id long, corpus_type string, weight double")
    asked = spark.createDataFrame([(q, {f"t{q % 5}": 1.0}) for q in range(40)], "query_id long, sparse map<string,double>")
    monkeypatch.setattr(products, "TASK_ROWS", 100)
    sums = products.sums(postings, asked, 3, chunk_block=50, query_block=10)
    assert set(re.findall(r"hashpartitioning\(_c#\d+, _q#\d+, (\d+)\)", plan(sums))) == {"10"} and sums.count() > 0


def test_tasks_of_the_clause_tree_follow_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure, "TASK_BLOCKS", 10)
    rows = [(v, k, "text", f"第{k + 1}条 甲", 1, None) for v in range(20) for k in range(5)]
    blocks = spark.createDataFrame(rows, "version_id long, idx int, kind string, text string, page int, page_end int")
    tree = structure.clause_tree(blocks)
    assert tree.rdd.getNumPartitions() == 11 and tree.where("level = 3").count() == 100


def test_indicators_are_made_once_for_a_decision(spark):
    found = catalog.QUERIES["quality_decisions"](spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(found)


def test_runs_are_made_in_one_pass_and_go_without_their_text(spark):
    texts = spark.createDataFrame([(1, "a𠀀b 甲乙丙"), (2, "a𠀀b 甲乙丙"), (3, "乙\n丙"), (4, ""), (5, None)], "i int, body string")
    terms = spark.createDataFrame([(1, "𠀀b"), (2, "乙丙"), (3, "\n"), (4, "丁"), (5, "乙丙")], "j int, term string")
    found = containment.holding(texts, terms, "body", "term")
    assert found.columns == ["i", "body", "j", "term"]
    assert sorted((r.i, r.j) for r in found.collect()) == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 5), (3, 3)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in text and not re.search(r"Generate explode\(array_distinct.*\[body", text)
    assert all("body" not in line.split("[")[-1] for line in text.splitlines() if "Generate explode" in line)

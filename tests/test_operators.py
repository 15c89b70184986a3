"""Operators on small literal inputs: structure, references, registry, quality, tables, alignment, streams."""

import datetime
import random
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from clauselake.operators import alignment, cases, curation, obligations, quality, references, registry, report, retrieval, routing, structure
from clauselake.sources import formats, tables

BLOCKS = "version_id long, idx int, kind string, text string, page int, page_end int"


def blocks(spark, lines, version=1):
    return spark.createDataFrame([(version, i, "text", t, i // 4 + 1, None) for i, t in enumerate(lines)], BLOCKS)


LINES = ["目录", "第一章 总则 1", "第一章 总则", "第一节 范围", "第一条 应当" + "甲" * 20, "正文", "（一）项", "第二条 x", "第二章 附则", "第三条 y", "第三条 z"]


def test_tree_and_chunks(spark):
    tree = {r.idx: r for r in structure.clause_tree(blocks(spark, LINES)).collect()}
    assert [tree[i].is_toc for i in range(3)] == [True, True, False]
    assert tree[6].path_norm == "1/1/1/1" and tree[5].path == "第一章 > 第一节 > 第一条" and tree[8].article_idx is None
    got = structure.clause_chunks(blocks(spark, LINES), limits=structure.ChunkLimits(5, 20, 50)).orderBy("emit_ord").collect()
    assert [(r.clause_path_norm, r.seq, r.is_parent) for r in got] == [("1/1", 0, True), ("1/1/1", 0, False), ("1/1/1", 1, False), ("1/1/2", 0, False), ("2/3", 0, False), ("2/3", 1, False)]
    assert got[2].text == "第一章 > 第一节 > 第一条\n第一条 应当" + "甲" * 20 + "\n" + "甲" * 5 + "\n正文\n（一）项" or got[2].text.endswith("（一）项")
    assert {r.parent_chunk_id for r in got[1:4]} == {got[0].chunk_id} and got[4].parent_chunk_id is None
    assert len({r.chunk_id for r in got}) == len(got)


def test_tree_matches_a_stack(spark):
    """Random heading sequences against the usual stack."""
    import random

    draw = random.Random(1)
    marks = {1: "第{}章 x", 2: "第{}节 x", 3: "第{}条 x", 4: "第{}款 x", 5: "（{}）x"}
    docs = []
    for v in range(30):
        lines = [draw.choice([*marks, None, None]) for _ in range(40)]
        docs.append((v, [("一段" if k is None else marks[k].format(draw.randint(1, 9)), k) for k in lines]))
    frame = spark.createDataFrame([(v, i, "text", t, 1, None) for v, lines in docs for i, (t, _) in enumerate(lines)], BLOCKS)
    got = {(r.version_id, r.idx): r for r in structure.clause_tree(frame).collect()}
    for v, lines in docs:
        stack = []
        for i, (_, level) in enumerate(lines):
            r = got[v, i]
            if level is not None and not r.is_toc:
                stack = [s for s in stack if s[0] < level] + [(level, r.number)]
            assert r.path_norm == "/".join(n for _, n in stack)


def test_tables_in_chunks(spark):
    html = "<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    row = spark.createDataFrame([(html,), (None,), ("<table></table>",)], "h string").select(formats.html_table(F.col("h")).alias("t"))
    made = row.where("t IS NOT NULL").select(formats.expanded_rows(F.col("t")).alias("r"), formats.markdown(F.col("t")).alias("m"), formats.empty_table(F.col("t")).alias("e")).collect()
    assert made[0].r == [["h", "h"], ["a", "b"], ["a", "c"]]
    assert made[0].m == "| h | h |\n| --- | --- |\n| a | b |\n| a | c |"
    assert [r.e for r in made] == [False, True]
    doc = blocks(spark, ["第一条 表", ""]).withColumn("kind", F.when(F.col("idx") == 1, "table").otherwise("text"))
    lines = row.where("t.n_rows > 0").select(F.lit(1).cast("long").alias("version_id"), F.lit(1).alias("idx"), formats.markdown_lines(F.col("t")).alias("l")).select("version_id", "idx", "l.head", "l.data")
    got = structure.clause_chunks(doc, lines, structure.ChunkLimits(1, 20, 50)).orderBy("emit_ord").collect()
    assert [(r.chunk_type, r.seq) for r in got] == [("clause", 0), ("table", 1), ("table", 2)]
    assert all(r.text.split("\n")[1:3] == ["| h | h |", "| --- | --- |"] for r in got[1:])


def test_questions_and_cases(spark):
    got = structure.question_chunks(blocks(spark, ["前言", "问：甲？", "答：乙", "丙", "2、丁", "无答", "问:戊", "答:己"])).orderBy("emit_ord").collect()
    assert [(r.clause_path, r.breadcrumb, r.text.split("答:")[1]) for r in got] == [("问答/1", "甲?", "乙\n丙"), ("问答/2", "戊", "己")]
    titles = spark.createDataFrame([(1, "决定书")], "version_id long, title string")
    got = structure.case_chunks(blocks(spark, ["抬头", "当事人：某公司", "地址", "经查，违规", "现决定罚款"]), titles).orderBy("emit_ord").collect()
    assert [r.clause_path for r in got] == ["案例/当事人", "案例/违规事实", "案例/处罚决定", "案例/摘要"]
    assert got[-1].text.endswith("决定书 当事人：某公司\n地址 经查，违规") and got[-1].chunk_type == "case_summary"
    assert [r.clause_path for r in structure.case_chunks(blocks(spark, ["无要素"]), titles).orderBy("emit_ord").collect()] == ["案例/全文", "案例/摘要"]


def test_obligations(spark):
    said = {"应当报告": ("应当", "obligation"), "对应当事人": (None, None), "相应，须经批准": ("须经", "obligation"), "无须审批": (None, None), "不得应": ("不得", "prohibition"), "责令改正": ("责令", "command"), "应不应": ("不应", "prohibition"), "说明": (None, None), "": (None, None)}
    frame = spark.createDataFrame([(k,) for k in said], "s string").withColumn("m", obligations.obligation_marker(F.col("s")))
    assert {r.s: (r.m, r.d) for r in frame.withColumn("d", obligations.deontic_class(F.col("m"))).collect()} == said


def test_spans_and_glosses(spark):
    row = spark.range(1).select(references.spans(F.lit("见第三条、第四条之一。"), references.INTERNAL[0][2]).alias("s")).first().s
    assert [tuple(x) for x in row] == [(1, 4, "第三条"), (5, 10, "第四条之一")]
    notes = F.array(*[F.struct(F.lit(e).alias("span_end"), F.lit(g).alias("gloss"), F.lit(r).alias("render")) for e, g, r in ((2, "甲", True), (4, "乙" * 40, True), (3, "丙", False))])
    assert spark.range(1).select(references.render_glosses(F.lit("abcdef"), notes).alias("t")).first().t == "ab〖甲〗cd〖" + "乙" * 30 + "〗ef"


def test_registration(spark):
    row = lambda name, **k: {c: "" for c in registry.MANIFEST} | {"filename": name, "perm_tag": "p"} | k
    manifest = spark.createDataFrame([row("a.pdf", supersedes="old.pdf"), row("b.pdf"), row("c.pdf", perm_tag=""), row("d.exe"), row("gone.pdf"), row("e.pdf", title="t", doc_number="n"), row("f.pdf", supersedes="x;y"), row("")])
    content = {"a.pdf": b"1", "b.pdf": b"1", "c.pdf": b"2", "d.exe": b"3", "e.pdf": b"4", "f.pdf": b"known"}
    files = spark.createDataFrame([(k, bytearray(v), "unknown" if k == "d.exe" else "pdf") for k, v in content.items()], "filename string, content binary, format string")
    import hashlib

    known = spark.createDataFrame([("v0", "l0", hashlib.sha256(b"known").hexdigest(), "old.pdf", "t", "n")], "version_id string, logical_id string, source_hash string, source_filename string, title string, doc_number string")
    got = {r.filename: r for r in registry.register_batch(manifest, files, known, "b").collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {"a.pdf": ("REGISTERED", None), "b.pdf": ("DUPLICATE", "same content"), "c.pdf": ("QUARANTINED", "no permission tag"), "d.exe": ("QUARANTINED", "format"), "gone.pdf": ("MISSING", "no such file"), "e.pdf": ("QUARANTINED", "suspected duplicate"), "f.pdf": ("DUPLICATE", "same content")}
    assert (got["a.pdf"].logical_id, got["a.pdf"].supersedes_version_id) == ("l0", "v0")
    assert got["b.pdf"].version_id == got["a.pdf"].version_id and got["f.pdf"].version_id == "v0" and got["f.pdf"].needs_review
    with pytest.raises(ValueError):
        registry.register_batch(manifest.drop("issuer"), files, known, "b")


def test_quality_gate(spark):
    rows = blocks(spark, ["第一条 a", "第二条 b", "第四条 c", "第三条 d"]).withColumns({"ocr_conf": F.lit(None).cast("double"), "table_empty": F.lit(False)})
    profiles = spark.createDataFrame([(1, "P-INT")], "version_id long, corpus_type string")
    verdict = quality.gate(quality.indicators(quality.indicator_values(rows), profiles)).first()
    assert not verdict.passed and verdict.failed == ["hierarchy_legality"]
    state = quality.next_states(quality.gate(quality.indicators(quality.indicator_values(rows), profiles))).first()
    assert (state.to_state, state.queue_type) == ("QC_FAILED", "qc_fix")


def test_dictionary_tags(spark):
    found = spark.createDataFrame([("c1", 1, ["A", "X", "A"], ["D"], ["M", "N"])], "chunk_id string, version_id long, entity_types array<string>, departments array<string>, matters array<string>")
    names = lambda *n: spark.createDataFrame([(x, "v1") for x in n], "name string, dict_version string")
    got = sorted((r.tag_type, r.tag_value) for r in obligations.dictionary_tags(found, names("A"), names("D"), names("N")).collect())
    assert got == [("department", "D"), ("entity_type", "A"), ("matter", "N")]


def test_issuers_and_domains(spark):
    issuers = spark.createDataFrame([("I1", "证监会", "部级"), ("I2", "上交所", "自律组织")], "code string, name string, issuer_level string")
    docs = spark.createDataFrame([(1, "证监会"), (2, "I2"), (3, "x"), (4, None)], "id int, issuer string")
    assert {r.id: r.issuer_level for r in cases.issuer_rank(docs, issuers).collect()} == {1: 3, 2: 2, 3: 0, 4: 0}
    assert {r.id: r.issuer_code for r in cases.resolve_issuer(docs, issuers).collect()} == {1: "I1", 2: "I2", 3: None, 4: None}
    rows = spark.createDataFrame([(1, "P-INT", "", ["a"]), (2, "P-EXT", "", []), (3, "P-EXT", "b", ["a"]), (4, "P-EXT", "a", ["a"])], "id int, corpus_type string, manifest_domain string, model_domains array<string>").withColumn("sample_key", F.lit("k"))
    assert {r.id: (r.domains, r.source, r.needs_review) for r in cases.business_domains(rows, 0.0).collect()} == {1: (["a"], "llm", True), 2: (None, None, False), 3: (["b"], "manifest", True), 4: (["a"], "manifest", False)}


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma 　delta"), (1, 3, "epsilon zeta")], "version_id long, page_no int, text string")
    rows = blocks(spark, ["alpha", "beta gamma", "missing altogether!", "deltx epsilon", " "])
    got = {r.idx: (r.page, r.page_end) for r in alignment.align_pages(rows, pages, 80.0).collect()}
    assert got == {0: (1, None), 1: (1, 2), 2: (None, None), 3: (2, 3), 4: (2, None)}
    at = spark.createDataFrame([(1, 0), (1, 9), (1, 10**6)], "version_id long, offset long")
    assert sorted(r.page_no for r in alignment.pages_at(alignment.page_offsets(pages), at).collect()) == [1, 2, 3]


def test_replay(spark):
    chunk = "chunk_id string, version_id long, breadcrumb string, text string, page_start int, page_end int, is_parent boolean, is_table boolean, degraded boolean"
    rows = [("a", 1, "p", "p\nalpha be", 1, None, False, False, False), ("b", 1, "", "nowhere to be found", 1, 1, False, False, False), ("c", 1, "", "x", None, None, False, True, False), ("d", 1, "", "gamma", 3, None, False, False, False)]
    pages = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma")], "version_id long, page_no int, text string")
    replayed = report.replay(spark.createDataFrame(rows, chunk), pages)
    assert {r.chunk_id: (r.exempt, r.matched) for r in replayed.collect()} == {"a": (False, True), "b": (False, False), "c": (True, True), "d": (False, True)}
    assert tuple(report.replay_summary(replayed).first()) == (3, 2, 1, pytest.approx(2 / 3))


def test_boosts_and_filters(spark):
    base, spans = F.create_map(F.lit("a"), F.lit(1.0)), F.array(F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(2.0)))
    assert spark.range(1).select(retrieval.boosted(base, spans, 2.0).alias("m")).first().m == {"a": 2.0, "b": 4.0}
    corpus = spark.createDataFrame([("a", "clause", ["x"], None), ("b", "clause", None, ["e"]), ("c", "table", ["x"], None)], "chunk_id string, chunk_type string, biz_domain array<string>, entity_type array<string>")
    assert [r.chunk_id for r in retrieval.filtered(corpus, domains=("x",)).collect()] == ["a"]
    with pytest.raises(ValueError):
        retrieval.dense_scores(corpus, corpus, 10**9)


def test_sentences_and_verdicts(spark):
    row = spark.range(1).select(routing.sentences(F.lit("一。二！三")).alias("a"), routing.sentences(F.lit("一。")).alias("b"), routing.without_verdict(F.lit("这样违规"), "中性").alias("c"), routing.without_verdict(F.lit("涉嫌"), "中性", True).alias("d"), routing.marked_ids(F.lit("[[clause_id:a]] [[clause_id:b]] [[clause_id:a]]")).alias("e"), routing.faithful(F.array(F.lit("x"), F.lit("a"), F.lit("a")), F.array(F.lit("a"))).alias("f")).first()
    assert (row.a.complete, row.a.tail, row.b.complete, row.b.tail) == (["一。", "二！"], "三", ["一。"], "")
    assert (row.c, row.d, row.e, row.f) == ("中性", "中性", ["a", "b"], ["a"])


def test_file_names(spark):
    names = spark.createDataFrame([("001_2024-01-02_关于披露的通知（2020年修订）.pdf",), ("警示函.docx",), ("x y/z.txt",)], "n string")
    got = names.select(curation.title_of(F.col("n")).alias("t"), curation.type_of(F.col("n")).alias("k"), curation.safe_stem(F.col("n")).alias("s")).collect()
    assert [(r.t, r.k) for r in got] == [("关于披露的通知", "外规·部门规章通知"), ("警示函", "案例"), ("x y/z", "未判定")]
    assert got[2].s == "x_y_z"
    files = spark.createDataFrame([("证券法注释",), ("其他",), ("公告〔2020〕3号全文",)], "title string")
    titles, numbers = curation.citations_in(spark.createDataFrame([("依据《证券法注释》和公告〔2020〕 3 号",)], "text string"))
    assert {r.title for r in curation.cited(files, titles, numbers).collect()} == {"证券法注释", "公告〔2020〕3号全文"}


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>题</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>正</w:t><w:t>文</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_formats(spark, tmp_path):
    for name, data in {"a.docx": _docx(), "b.pdf": b"%PDF-1.4", "c.png": b"\x89PNG\r\n\x1a\n1", "d.bin": b"PK\x03\x04broken", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = formats.files(spark, str(tmp_path))
    assert {r.filename: r.format for r in found.select("filename", "format").collect()} == {"a.docx": "docx", "b.pdf": "pdf", "c.png": "png", "d.bin": "unknown", "e.txt": "unknown"}
    rows = formats.office_blocks(found.where("format IN ('docx', 'pdf')")).collect()
    assert [(r.kind, r.text) for r in rows if r.error is None] == [("heading", "题"), ("text", "正文"), ("table", "a\tb")]
    assert [r.error for r in rows if r.error] == ["E101"]


def test_ocr_output(spark):
    page = '{"pdf_info":[{"page_idx":0,"para_blocks":[{"type":"title","level":1,"lines":[{"spans":[{"content":"题","score":0.9},{"content":"目","score":0.8}]}]},{"type":"image"},{"type":"table","score":0.7,"blocks":[{"lines":[{"spans":[{"html":"<table><tr><td>x</td></tr></table>"}]}]}]}]},{"page_idx":1,"para_blocks":[{"type":"text","lines":[{"spans":[{"content":"一"}]},{"spans":[{"content":"二"}]}]}]}]}'
    got = formats.ocr_blocks(spark.createDataFrame([(1, page)], "version_id long, json string")).orderBy("idx").collect()
    assert [(r.idx, r.kind, r.text, r.page, r.ocr_conf) for r in got] == [(0, "heading", "题目", 1, 0.8), (1, "table", "", 1, 0.7), (2, "text", "一\n二", 2, None)]


def test_tables_on_disk(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿oral_term,legal_terms\n代客理财,全权委托|受托理财\n空,\n", encoding="utf-8")
    terms = tables.scenario_terms(tables.dictionary(spark, str(tmp_path / "d.csv"), "scenario_terms"))
    assert [(r.oral_term, r.legal_terms) for r in terms.collect()] == [("代客理财", ["全权委托", "受托理财"])]
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "version_id int, text string")
    tables.replace_partitions(make([(1, "a"), (2, "b")]), path, "version_id")
    tables.replace_partitions(make([(2, "c")]), path, "version_id")
    assert sorted((r.version_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    from clauselake.streaming import events

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, 1, "REGISTERED", None, at(0)), (2, 1, "PARSING", None, at(1)), (3, 1, "INDEXED", None, at(2)), (4, 2, "PARSING", None, at(9))]
    log = spark.createDataFrame(rows, events.SCHEMA)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    steps = {r.id: (r.from_state, r.legal) for r in events.lifecycle_table(log).collect()}
    assert steps == {1: (None, True), 2: ("REGISTERED", True), 3: ("PARSING", False), 4: (None, False)}
    want = sorted(map(tuple, events.lifecycle_table(log).collect()))
    longer = spark.createDataFrame([(k, k % 3, draw, None, at(0)) for k, draw in enumerate(random.Random(5).choices(["REGISTERED", "PARSING", "QC_PENDING", "QC_FAILED", "STRUCTURING", "EMBEDDING", "INDEXING", "INDEXED", None], k=400))], events.SCHEMA)
    whole = sorted(map(tuple, events.lifecycle_table(longer, piece=1000).collect()))
    assert sorted(map(tuple, events.lifecycle_table(longer, piece=7).collect())) == whole and len(whole) == 400 and sum(r[4] for r in whole) > 40
    stream = events.lifecycle(events.read(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "steps")).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").trigger(availableNow=True)
    with_state = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if with_state is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", with_state)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "steps")).select("version_id", "id", "from_state", "to_state", "legal").collect())) == want
    once = events.first_of_each(events.read(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 4
    query = events.windowed_counts(events.read(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3  # the last window is still open


def test_questions_beyond_one_block(spark):
    rows = [(k, "P-INT", [float(k % 7), float(k % 5), 1.0]) for k in range(30)]
    corpus = spark.createDataFrame(rows, "chunk_id long, corpus_type string, dense array<double>")
    queries = corpus.select(F.col("chunk_id").alias("query_id"), "dense")
    ranked = lambda found: sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect())
    want = ranked(retrieval.dense_best(corpus, queries, 30, 3))
    assert len(want) == 90 and ranked(retrieval.dense_best(corpus, queries, 30, 3, block=15)) == want
    assert len(ranked(retrieval.dense_best(corpus, queries, 10_001, 3))) == 90

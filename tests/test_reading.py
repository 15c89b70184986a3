"""Agencies, parties, numbers, titles and references as they are read from single lines."""

from pyspark.sql import functions as F

from clauselake.functions import text as X
from clauselake.operators import cases, curation, references


def read(spark, values, expression):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r.v for r in frame.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


def test_agencies(spark):
    lines = ["中国证监会北京监管局", "(2024) 局", "局长会", "关于某厅。北京市局", "某省人民委员会办公室", "无", "", None, "甲" * 60 + "局"]
    assert read(spark, lines, lambda s: cases.penalty_org(F.array(s))) == ["中国证监会", None, "局长会", "关于某厅", "某省人民委员会", None, None, None, "甲" * 40 + "局"]


def test_parties(spark):
    texts = ["当事人：某某公司，住所", "当事人，被处罚人 张三；", "被检查单位:A公司", "无人", "", None, "当事人：" + "长" * 50]
    assert read(spark, texts, lambda s: cases.respondent(s, F.array(F.lit("")))) == ["某某公司", "张三", "A公司", None, None, None, "长" * 40]
    lines = ["某某证券公司、李四：", "经查某某公司：", "某某公司：注意：", "某某公司" + "后" * 41 + "：", "某某公司" + "后" * 40 + "：", "公司：", "某某银行", None]
    assert read(spark, lines, lambda s: cases.respondent(F.lit(""), F.array(s))) == ["某某证券公司", None, None, None, "某某公司", None, None, None]


def test_document_numbers_and_titles(spark):
    texts = ["见证监会公告〔2020〕 5 号和证监发[2019]第12号", "令 2018 3号", "【2021】7号；银发〔2001〕1号", "2020年5号", "", None]
    assert read(spark, texts, curation.numbers_in) == [["证监会公告〔2020〕5号", "证监发[2019]第12号"], ["令20183号"], ["【2021】7号", "发〔2001〕1号"], [], [], []]
    names = ["001_2024-01-02_办法（2020年修订）.pdf", "12-规定【试行】.docx", "2024-01", "a_1_b.txt", "1_2_3_4_5_6_x.pdf", "x（一）（2019年）.doc", None]
    assert read(spark, names, curation.title_of) == ["办法", "规定【试行】", "01", "a_1_b", "6_x", "x（一）", None]


def test_references_in_one_pass(spark):
    text = "见第三条之一和本条例，前条及前两款、前款，上述各款，本章。"
    chunks = spark.createDataFrame([("c", 1, "1/2", "", text, False, "clause", 1)], "chunk_id string, version_id int, clause_path_norm string, breadcrumb string, text string, is_parent boolean, chunk_type string, emit_ord int")
    found = sorted((r.span_start, r.span_end, r.surface, r.ref_type) for r in references.internal_references(chunks).collect())
    assert [(x[2], x[3]) for x in found] == [("第三条之一", "R3"), ("本条", "R1"), ("本条例", "R1"), ("前条", "R2"), ("前两款", "R2"), ("前款", "R2"), ("上述各款", "R2"), ("本章", "R1")]
    assert all(text[a:b] == s for a, b, s, _ in found)


def test_mentions_are_read_in_turn(spark):
    text = "《甲法》（证监会令〔2020〕1号）第二条之三，《乙法》（试行）第一条，《丙》第十条。《》"
    chunks = spark.createDataFrame([("c", 1, "1", "", text, False, "clause", 1)], "chunk_id string, version_id int, clause_path_norm string, breadcrumb string, text string, is_parent boolean, chunk_type string, emit_ord int")
    found = sorted((r.span_start, r.surface, r.title, r.doc_number, r.clause_raw) for r in references.cross_mentions(chunks).collect())
    assert [x[1:] for x in found] == [("《甲法》（证监会令〔2020〕1号）第二条之三", "甲法", "证监会令〔2020〕1号", "第二条之三"), ("《乙法》", "乙法", None, None), ("《丙》第十条", "丙", None, "第十条")]
    assert X.NUMERAL

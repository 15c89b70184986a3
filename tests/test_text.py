"""Text expressions on literals, with expectations written by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from clauselake.functions import dates, folds, text as X


def values(spark, inputs, expression):
    rows = [(k, v) for k, v in enumerate(inputs)]
    return [r.v for r in spark.createDataFrame(rows, "k int, s string").select("k", expression(F.col("s")).alias("v")).orderBy("k").collect()]


def test_numerals(spark):
    cases = {"二十一": 21, "十": 10, "一百零三": 103, "两千": 2000, "二千三百四十五": 2345, "２１": 21, " 1 2 ": 12, "一二三": 3, "〇": 0, "2十": None, "第": None, "": None, None: None}
    assert values(spark, cases, X.chinese_to_int) == list(cases.values())


def test_clause_numbers(spark):
    cases = {"二十一": "21", "21": "21", "二十一之一": "21-1", "21之1": "21-1", "21bis": "21-1", "21TER": "21-2", "21.1b": "21-1", "二 十": "20", "x": None, "": None, "二十之2十": None}
    assert values(spark, cases, X.clause_number) == list(cases.values())


def test_headings(spark):
    cases = {
        "第一章 总则": (1, "1", "第一章"),
        "第 二 节 x": (2, "2", "第二节"),
        "第二十一条之一 内容": (3, "21-1", "第二十一条之一"),
        "第21bis条 x": (3, "21-1", "第21bis条"),
        "2.17 内容": (3, "2.17", "2.17"),
        "第十款 x": (4, "10", "第十款"),
        "（一）项": (5, "1", "(一)"),
        "三、啊": (5, "3", "三、"),
        "③ 目": (6, "3", "③"),
        "第一百九十六条、依照": None,
        "第三条第二款": None,
        "第三条的规定": None,
        "2.17% x": None,
        "10.1.3 条或者": None,
        "普通": None,
        "": None,
        None: None,
    }
    assert [None if v is None else tuple(v) for v in values(spark, cases, X.heading)] == list(cases.values())


def test_normal_forms(spark):
    assert values(spark, ["Ａ　（１） b", None], X.normalise) == ["A(1)b", ""]
    assert values(spark, ["⽉⽇⾏a"], X.unify_radicals) == ["月日行a"]
    assert values(spark, ["京证监〔2024〕5号", "【1】"], X.normalise_doc_number) == ["京证监[2024]5号", "[1]"]
    assert values(spark, ["中文abc" * 3, "", None], lambda s: X.truncate_bytes(s, 8)) == ["中文ab", "", None]
    assert values(spark, ["  abcdef ", "ab", None], lambda s: X.excerpt(s, 3)) == ["abc…", "ab", ""]
    assert [[list(x) for x in v] for v in values(spark, ["1/10-2/3.4", "a"], X.path_key)] == [[[1], [10, 2], [3, 4]], [[0]]]


def test_mentions(spark):
    found = values(spark, ["根据第三条之二和第五章、第 21bis 条", "无"], X.internal_references)
    assert [[tuple(r) for r in v] for v in found] == [[("条", "3-2", "第三条之二"), ("章", "5", "第五章"), ("条", "21-1", "第21bis条")], []]


def test_dates_and_durations(spark):
    cases = {"应在九十日内": ("九十日", "parsed", 90, False), "5个工作日": ("5个工作日", "parsed", 5, True), "半年内或三十日": ("半年", "parsed", 180, False), "三季": ("三季", "parsed", 270, False), "次年首个工作日": ("次年", "unparsed", None, None), "无": None}
    assert [None if v is None else tuple(v) for v in values(spark, cases, dates.duration)] == list(cases.values())
    assert values(spark, ["2024年2月30日2024年3月1日和2023-1-5", "2024年3月1日", "无"], dates.last_date) == [datetime.date(2023, 1, 5), datetime.date(2024, 3, 1), None]
    assert values(spark, ["2024-02-29", "2023-02-29", "x", None], dates.iso_date) == [datetime.date(2024, 2, 29), None, None, None]
    assert values(spark, ["罚款1,234.5万元又3元", "罚款 3000 元", "无"], dates.amount_in_ten_thousands) == [1234.5, 0.3, None]


def pack(items, budget):
    groups, open_, cost = [], [], 0
    for x in items:
        if open_ and cost + len(x) > budget:
            groups.append(open_)
            open_, cost = [], 0
        open_.append(x)
        cost += len(x)
    return groups + [open_] if open_ else groups


@pytest.mark.parametrize("budget", [3, 8])
def test_packing(spark, budget):
    lists = [["aaaa", "bbbb", "c", "dd", "e"], ["a"], [], ["abcdefghij", "k"], ["a", "b", "c", "d", "e", "f"]]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<string>")
    packed = folds.pack(F.col("v"), "string", F.length, budget)
    got = [r for r in frame.select("k", packed.alias("p"), folds.merge_short_tail(packed, "string", F.length, 3).alias("m")).orderBy("k").collect()]
    for r, items in zip(got, lists, strict=True):
        want = pack(items, budget)
        assert r.p == want
        while len(want) > 1 and sum(map(len, want[-1])) < 3:
            want[-2].extend(want.pop())
        assert r.m == want


def test_long_paragraphs(spark):
    text = "aaaa；bbbb。（一）cccc（二）" + "d" * 25
    got = values(spark, [text], lambda s: folds.split_long(s, 10))[0]
    assert [tuple(p) for p in got] == [("aaaa；bbbb。", False), ("（一）cccc", False), ("（二）ddddddd", True), ("d" * 10, True), ("d" * 8, True)]

"""Web pages by a table function, and office files by a data source."""

import re

from pyspark.sql import functions as F

from clauselake.plans import functions
from clauselake.sources import office, pages

SF = "/root/testdata/sf0.001"


def blocks(spark, html):
    frame = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    out = {}
    for r in sorted(pages.page_blocks(frame).collect(), key=lambda r: (r.page_id, r.idx)):
        cells = None if r.cells is None else [(c.text, c.row, c.col, c.rowspan, c.colspan) for c in r.cells]
        out.setdefault(r.page_id, []).append((r.kind, r.level, r.text) if cells is None else (r.n_rows, r.n_cols, cells))
    return [out.get(k, []) for k in range(len(html))]


def test_pages(spark):
    html = [
        "<head><title>x</title></head><body><h2>A <b>b</b>\n c</h2>one<p>two <i>2</i><p>three<script>var a='</p>';</script> 3</body>",
        None,
        "",
        "plain &amp; simple &lt;",
        "<head><title>never closed<body><h1>T</h1><!-- no --><h3>U",
        "<table><tr><td rowspan=2>a<td colspan='2'>b<tr><td>c</td><td>d</td></tr></table>after",
        "<table><tr><td>x<table><tr><td>in</td><td>ner</td></tr></table>y</td><td rowspan=99 colspan=-1>z</table>",
        "<table><td>no row<tr><th>q</th><td></td>",
        "<p>a</p><style>p{}</style><li>b</li></table></div><tr><td>c</td>",
    ]
    assert blocks(spark, html) == [
        [("heading", 2, "A b c"), ("text", None, "one"), ("text", None, "two 2"), ("text", None, "three 3")],
        [],
        [],
        [("text", None, "plain & simple <")],
        [("heading", 1, "T"), ("heading", 3, "U")],
        [(2, 3, [("a", 0, 0, 2, 1), ("b", 0, 1, 1, 2), ("c", 1, 1, 1, 1), ("d", 1, 2, 1, 1)]), ("text", None, "after")],
        [(1, 2, [("x in ner y", 0, 0, 1, 1), ("z", 0, 1, 1, 1)])],
        [(2, 2, [("no row", 0, 0, 1, 1), ("q", 1, 0, 1, 1), ("", 1, 1, 1, 1)])],
        [("text", None, "a"), ("text", None, "b"), ("text", None, "c")],
    ]


def test_whole_table_of_pages(spark):
    """The given pages have no tables, and no tag within a word: their text between block tags is all there is."""
    import html as entities

    found = {}
    for r in sorted(functions.QUERIES["page_blocks"](spark, SF).collect(), key=lambda r: (r.page_id, r.idx)):
        found.setdefault(r.page_id, []).append((r.level, r.text))
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", row.html or "")
        want = []
        for part in re.split(r"(?=<h1>)|(?<=</h1>)|<(?!/?(?:h1|a|b|i|em|span)\b)[^>]*>", body):
            text = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", part)).split())
            if text:
                want.append((1 if part.startswith("<h1>") else None, text))
        assert found.get(row.page_id, []) == want, row.page_id


def test_office_files(spark, tmp_path):
    path = str(tmp_path / "in")
    docs = spark.createDataFrame([("a.docx", [("heading", "H"), ("text", " x < & > y "), ("table", "1\t2\n3\t"), ("text", "")]), ("b.docx", None), ("c.docx", [])], "name string, blocks array<struct<kind string, text string>>")
    assert {r.name for r in office.write_docx(docs, path).collect()} == {"a.docx", "b.docx", "c.docx"}
    (tmp_path / "in" / "d.txt").write_text("no office file")
    (tmp_path / "in" / ".hidden").write_text("x")
    want = {("a.docx", 0, "heading", "H", "Heading1", None), ("a.docx", 1, "text", " x < & > y ", None, None), ("a.docx", 2, "table", "1\t2\n3\t", None, None), ("b.docx", 0, None, None, None, "E101"), ("d.txt", 0, None, None, None, "E101")}
    for most in (1, 1 << 20):
        read = office.read_office(spark, path, most)
        assert {(r.path.rsplit("/", 1)[1], r.idx, r.kind, r.text, r.style, r.error) for r in read.collect()} == want
    assert office.read_office(spark, path, 1).rdd.getNumPartitions() == 4
    assert read.select(F.count_if(F.col("error").isNotNull()).alias("n")).first().n == 2

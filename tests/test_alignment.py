"""Placing blocks on pages: planted edits, repeated lines, and the bit-parallel edit distance."""

import random

from pyspark.sql import functions as F

from clauselake.operators import alignment


def edits_to_any_stretch(needle, text):
    """(edits, end) by the plain table: the first end with the fewest."""
    row = list(range(len(needle) + 1))
    best, at = len(needle), 0
    for k, c in enumerate(text):
        new = [0]
        for i, d in enumerate(needle):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best:
            best, at = row[-1], k + 1
    return best, at


def test_fewest_edits():
    draw = random.Random(2)
    for _ in range(300):
        needle, text = ("".join(draw.choices("abc", k=draw.randrange(n))) for n in (90, 120))
        if needle:
            assert alignment._nearest_end(needle, text) == edits_to_any_stretch(needle, text)


def test_planted_edits(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("甲乙丙丁戊己庚辛abcdefgh", k=draw.randrange(1, 9)))
    blocks, pages, want = [], [], {}
    for doc in range(12):
        lines = [" ".join(word() for _ in range(draw.randrange(1, 14))) for _ in range(60)]
        lines[10:40:6] = ["repeated line of every page"] * 5
        text = list(lines)
        for k in range(0, 60, 7):  # what the page says differs from the block here and there
            solid = text[k].replace(" ", "")
            if len(solid) >= 30:
                at = draw.randrange(len(solid))
                text[k] = solid[:at] + draw.choice(["", "X", "XY"]) + solid[at + 1 :]
        for k, line in enumerate(lines):
            blocks.append((doc, k, line))
            want[doc, k] = 1 + k // 6
        blocks.append((doc, 60, "a line that stands on no page whatsoever, at all"))
        want[doc, 60] = None
        pages += [(doc, n + 1, "\n".join(text[n * 6 : n * 6 + 6])) for n in range(10)]
    rows = spark.createDataFrame(blocks, "version_id long, idx int, text string").withColumns({"page": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
    got = {(r.version_id, r.idx): (r.page, r.page_end) for r in alignment.align_pages(rows, spark.createDataFrame(pages, "version_id long, page_no int, text string")).collect()}
    wrong = {k for k, page in want.items() if got[k] != (page, None)}
    # A short line may stand elsewhere between its neighbours as well.
    assert len(wrong) <= len(want) * 0.01 and all(got[k][0] is None or want[k] is None or abs(got[k][0] - want[k]) <= 1 for k in wrong)
    assert not any(k in wrong for k in want if want[k] is None)


def test_short_lines_beside_changed_ones(spark):
    draw = random.Random(7)
    line = lambda n: "".join(draw.choices("abcdefghijklmnop", k=n))
    blocks, pages, want = [], [], {}
    for doc in range(40):
        # On the page the third line lacks a character near its head, near its end, or in its middle.
        lines = [line(150), "责令 Du.", line(240), "应 Ea.", line(150)]
        at = (25, 215, 120)[doc % 3]
        text = [*lines[:2], lines[2][:at] + lines[2][at + 1 :], *lines[3:]]
        first = 1 + doc // 3 % 3  # the changed line is in the middle, first or last on its page
        blocks += [(doc, k, x) for k, x in enumerate(lines)]
        pages += [(doc, 1, "\n".join(text[:first])), (doc, 2, "\n".join(text[first:]))]
        want |= {(doc, k): (1 if k < first else 2, None) for k in range(5)}
    rows = spark.createDataFrame(blocks, "version_id long, idx int, text string").withColumns({"page": F.lit(None).cast("int"), "page_end": F.lit(None).cast("int")})
    got = {(r.version_id, r.idx): (r.page, r.page_end) for r in alignment.align_pages(rows, spark.createDataFrame(pages, "version_id long, page_no int, text string")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_a_document_without_pages_or_blocks(spark):
    none = spark.createDataFrame([], "version_id long, page_no int, text string")
    rows = spark.createDataFrame([(1, 0, "text", 7, None), (1, 1, " ", 7, None), (1, 2, None, 5, 6)], "version_id long, idx int, text string, page int, page_end int")
    assert sorted((r.idx, r.page, r.page_end) for r in alignment.align_pages(rows, none).collect()) == [(0, None, None), (1, 7, None), (2, 5, 6)]
    assert alignment.align_pages(rows.limit(0), none).count() == 0

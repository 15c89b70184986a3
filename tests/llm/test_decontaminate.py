import random
import re

import pytest

from clauselake.llm.decontaminate import find_contamination


def words(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_force(docs, items, width):
    out = {}
    for doc_id, text in docs:
        own, hit, ids = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            wins = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
            for win in wins:
                for k in range(len(own) - len(win) + 1):
                    if tuple(own[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        ids.add(str(item_id))
        out[doc_id] = (len(own), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize(("width", "part_bytes"), [(10, 1 << 20), (3, 1 << 20), (3, 40)])
def test_against_brute_force(spark, width, part_bytes):
    draw = random.Random(width)
    vocabulary = ["a", "B", "né", "日本", "x1", "y"]
    run = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(run(draw.choice([0, 1, 2, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "!!"), (9, "Solo-Item")]
    docs = [(0, None), (1, ""), (2, "solo item"), (3, "?!")]
    for k in range(4, 60):
        parts = run(draw.randint(0, 30)) + (draw.choice(items)[1] or "").split() + run(3)
        docs.append((k, draw.choice([" ", ", ", "\n", "--"]).join(parts)))
    bench = spark.createDataFrame([(i, t, "n_hit") for i, t in items], "item_id long, text string, extra string")
    frame = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, n_hit int")
    got = find_contamination(frame, bench, width=width, part_bytes=part_bytes, carry=("n_hit",)).collect()
    want = brute_force(docs, items, width)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    for r in got:  # spans lie on the text as it was
        raw = (dict(docs)[r.doc_id] or "").encode()
        assert sum(len(words(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit


def test_limits(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in find_contamination(docs, none).collect()] == [0, 0]
    assert find_contamination(spark.createDataFrame([], docs.schema), none).count() == 0


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    long = "filler words " * 200_000 + passage + " end" * 1000
    docs = spark.createDataFrame([(1, long, 0, 0), (1, long, 1, 1), (2, passage.upper(), 2, 2), (2, passage.upper(), 2, 2), (3, "clean", 3, 3)], "doc_id long, text string, _key int, spans int")
    bench = spark.createDataFrame([("b", passage), ("b", passage), ("a", " ".join(["x", passage, "y"])), (None, "clean")], "item_id string, text string")
    for part_bytes in (1 << 20, 30):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in find_contamination(docs, bench, part_bytes=part_bytes).collect())
        assert got == [(1, 401_012 , 12, ["a", "b"])] * 2 + [(2, 12, 12, ["a", "b"])] * 2 + [(3, 1, 0, [])]


def test_an_item_longer_than_a_part(spark):
    item = " ".join(f"w{k % 97}" for k in range(3000))
    words_ = item.split()
    docs = spark.createDataFrame([(k, " ".join(["zz", *words_[k : k + 10], "zz"])) for k in range(0, 2990, 13)], "doc_id long, text string")
    got = find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), part_bytes=700).collect()
    assert all((r.n_words, r.n_hit) == (12, 10) for r in got)


def test_words_that_polynomials_take_for_one(spark):
    from test_common import unlike_words

    one, other = unlike_words()
    found = find_contamination(spark.createDataFrame([(0, f"x {one}"), (1, f"x {other}")], "doc_id long, text string"), spark.createDataFrame([("i", one)], "item_id string, text string"), width=10)
    assert sorted((r.doc_id, r.n_hit) for r in found.collect()) == [(0, 1), (1, 0)]

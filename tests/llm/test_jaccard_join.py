import random
import re

import pytest

from clauselake.llm import jaccard_join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute_force(rows, width, num, den):
    ids = [i for i, _ in rows]
    sets = [shingles(t, width) for _, t in rows]
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
                links[ids[a]] += 1
                links[ids[b]] += 1
    return sorted((i, len(s), find(i), links[i]) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n_words):
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % 4000}"
    texts = [None, "", "  \t ", "One", "one", "two words", "Two  words"]
    for _ in range(40):
        base = [word() for _ in range(draw.randint(3, n_words))]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            copy = base.copy()
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    common = [word() for _ in range(30)]
    texts += [" ".join([*common, word(), *common]) for _ in range(30)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "num", "den", "words"), [(1, 3, 90, 100, 200), (2, 5, 80, 100, 120), (3, 3, 90, 100, 40), (4, 1, 50, 100, 30)])
def test_against_brute_force(spark, seed, width, num, den, words):
    rows = corpus(seed, words)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(3)
    for block in (1024, 16):
        want = brute_force(rows, width, num, den)
        ways = {"width": width, "num": num, "den": den, "block": block, "shard_sets": 64}
        assert sorted(map(tuple, jaccard_join.similar_components(frame, **ways, count_links=True).collect())) == want
        assert sorted(map(tuple, jaccard_join.similar_components(frame, **ways).collect())) == [row[:3] for row in want]


def test_near_copy_chain(spark):
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):  # each differs from the next in one more word
        rows.append((100 - k, " ".join(["x"] * 0 + [f"y{j}" if j < 6 * k else w for j, w in enumerate(base)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.similar_components(frame, count_links=True).collect())) == brute_force(rows, 3, 90, 100)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.similar_components(spark.createDataFrame([], schema)).count() == 0
    got = jaccard_join.similar_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None), (7, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (7, 7)]


def test_links_of_repeats_and_shared_ids(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(None, near), (4, near), (4, near), (9, near + " x"), (9, "p q r s"), (2, None), (3, "p q r s")]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True).collect()
    # Row 9 stands twice: its first text links with the three rows of 4, its second with row 3.
    assert sorted((r.doc_id or -1, r.n_shingles, r.n_links) for r in got) == [(-1, 58, 3), (2, 0, 0), (3, 2, 1), (4, 58, 3), (4, 58, 3), (9, 2, 1), (9, 59, 3)]


def test_words_that_polynomials_take_for_one(spark):
    from test_common import unlike_words

    rows = list(enumerate(unlike_words()))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=90, den=100, count_links=True)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == [(0, 1, 0, 0), (1, 1, 1, 0)]


def test_sets_of_large_classes_are_sent_once(spark, monkeypatch):
    draw, tasks, deal = random.Random(3), [], jaccard_join._search_tasks
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        words[draw.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "_search_tasks", lambda *args: tasks.append(deal(*args)) or tasks[-1])
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), num=80, den=100, block=8, count_links=True)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 3, 80, 100)
    assert tasks[0].count() == tasks[0].select("node").distinct().count() == 60

import hashlib
import random
from collections import Counter

import pytest

from clauselake.llm.suffix_dedup import COVERS, cover_for, remove_repeats


def brute_force(texts, span):
    seen = Counter(t[k : k + span] for t in texts for k in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - span + 1):
            if seen[t[k : k + span]] > 1:
                gone[k : k + span] = [True] * span
        starts = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((len(t), sum(gone), len(starts), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("v", COVERS)
def test_every_distance_is_a_difference(v):
    assert {(a - b) % v for a in COVERS[v] for b in COVERS[v]} == set(range(v))


def check(spark, texts, span, **more):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, block string, at int").repartition(3)
    rows = {r.doc_id: r for r in remove_repeats(docs, span=span, **more).collect()}
    want = brute_force([(t or "").encode() for t in texts], span)
    assert len(rows) == len(texts)
    for k, (n, removed, n_spans, kept) in enumerate(want):
        r = rows[k]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == (n, removed, n_spans, kept), k


@pytest.mark.parametrize(("seed", "span", "letters"), [(1, 20, "ab"), (2, 33, "abcde"), (3, 200, "abcdéü \n"), (4, 12, "a")])
def test_against_brute_force(spark, seed, span, letters):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice(letters + "xyz"[: len(letters) - 1]) for _ in range(n))
    passages = [word(draw.randint(span // 2, 4 * span)) for _ in range(6)]
    texts = [None, "", "short", "a" * (span - 1), "a" * span, "z" * (3 * span)]
    for _ in range(40):
        parts = []
        for _ in range(draw.randint(1, 5)):
            p = draw.choice(passages)
            a = draw.randint(0, len(p) - 1)
            parts += [word(draw.randint(0, span)), p[a : draw.randint(a, len(p))] if draw.random() < 0.6 else p]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[11][:-1], "b" + texts[12]]
    near = list(texts[13] * 2)
    for _ in range(20):
        copy = near.copy()
        copy[draw.randrange(len(copy))] = "q"
        texts.append("".join(copy))
    check(spark, texts, span, block_bytes=1 << 10)
    check(spark, texts, span)


def test_empty_table_and_null_ids(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = remove_repeats(spark.createDataFrame([(None, "k" * 300), (None, None)], "doc_id long, text string")).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 0]
    assert {len(r.spans) for r in rows} == {0, 1}


def test_long_text(spark):
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh") for _ in range(700))
    long = "".join(draw.choice("abcdefgh") for _ in range(300_000))
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, long + passage + long[:5000]), (2, "zz" + passage)], "doc_id long, text string"), block_bytes=1 << 16).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(2, 702)]
    assert hashlib.sha256(rows[2].kept).hexdigest() == hashlib.sha256(b"zz").hexdigest()
    assert sum(s.end - s.start for s in rows[1].spans) == 10_700

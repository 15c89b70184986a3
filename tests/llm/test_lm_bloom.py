import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm.lm_bloom import LEAST, VALUES, LogFrequencyFilter, build_segment, learn_model, score_texts, training_rows


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute_force(train, texts):
    c = Counter(t for x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for x in texts:
        own = tokens(x)
        out.append((len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)))
    return out


@pytest.mark.parametrize("head_words", [2_000_000, 5])
def test_base_scores_are_exact(spark, head_words):
    draw = random.Random(1)
    words = ["Alpha", "alpha", "be", "c", "dé", "e" * 300] + [f"w{k}" for k in range(60)]
    train = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(80)] + [None, ""]
    texts = [*train[:20], None, "", "never seen", "a\tb\nc\x0bd", "ALPHA be " * 3000]
    frame = lambda rows: spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, score string")
    model = learn_model(frame(train), head_words=head_words)
    got = {r.doc_id: r for r in score_texts(frame(texts), model).collect()}
    for k, (n, known, total, base) in enumerate(brute_force(train, texts)):
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (n, known, total)
        assert got[k].base_score == pytest.approx(base, rel=1e-9)
        assert got[k].score < 0


def test_likely_texts_score_higher(spark):
    draw = random.Random(2)
    line = lambda: "the cat sat on the mat and the dog ran home".split()
    train = [" ".join(line()) for _ in range(200)]
    odd = line()
    draw.shuffle(odd)
    frame = spark.createDataFrame([(0, train[0]), (1, " ".join(odd))], "doc_id long, text string")
    model = learn_model(spark.createDataFrame([(k, t) for k, t in enumerate(train)], "doc_id long, text string"))
    got = {r.doc_id: r for r in score_texts(frame, model).collect()}
    assert got[0].score > got[1].score + 1 and got[0].base_score == pytest.approx(got[1].base_score)


def level(count):
    return max(k for k in range(40) if k == 0 or count >= math.ceil(1.5 ** (k - 1) - 1e-9))


def value(k):
    return 0 if k == 0 else (math.ceil(1.5 ** (k - 1) - 1e-9) + math.ceil(1.5**k - 1e-9) - 1) / 2


def brute_scores(train, texts):
    """The model by an exact table of counts, quantised alike."""
    grams, starts = Counter(), len(train)
    for x in train:
        own = tokens(x)
        for k in range(len(own)):
            grams[tuple(own[k : k + 1])] += 1
            grams[(own[k - 1] if k else "<s>", own[k])] += 1
            if k:
                grams[(own[k - 2] if k > 1 else "<s>", own[k - 1], own[k])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def contexts(own, k):
        """(order, n-gram, level of the context) of the token at place k."""
        two = (own[k - 1] if k else "<s>", own[k])
        yield 2, two, level(grams[two[:1]] if k else starts)
        if k:
            three = (own[k - 2] if k > 1 else "<s>", own[k - 1], own[k])
            yield 3, three, level(grams[three[:2]])

    new, seen = Counter(), Counter()
    for x in train:
        own = tokens(x)
        for k in range(len(own)):
            for order, gram, at in contexts(own, k):
                seen[order, at] += 1
                new[order, at] += grams[gram] == 1

    def weight(order, at):
        read = at + 1 if at in (1, 2, 3) else at
        return min(1, max(1e-4, (new[order, read] + 0.5) / (seen[order, read] + 1)))

    out = []
    for x in texts:
        own, total = tokens(x), 0.0
        for k in range(len(own)):
            p = (value(level(grams[own[k],])) + 0.5) / (n + 0.5 * (v + 1))
            for order, gram, at in contexts(own, k):
                if at:
                    b = weight(order, at)
                    p = (1 - b) * value(level(grams[gram])) / value(at) + b * p
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("filter_bytes", [256 << 20, 64])
def test_scores_equal_an_exact_table(spark, filter_bytes):
    draw = random.Random(3)
    words = ["Alpha", "alpha", "be", "dé"] + [f"w{k}" for k in range(40)]
    line = lambda: " ".join(words[min(int(draw.expovariate(0.15)), len(words) - 1)] for _ in range(draw.randint(0, 40)))
    train = [line() for _ in range(120)] + [None, "", "be", "w1 w2 w3 w4", "w1 w2 w3 w4"]
    texts = [*train[:30], None, "", "never seen before", "be " * 2000, *(line() for _ in range(40))]
    frame = lambda rows: spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    model = learn_model(frame(train), filter_bytes=filter_bytes, bits_per_event=500)
    got = {r.doc_id: r.score for r in score_texts(frame(texts), model).collect()}
    for k, want in enumerate(brute_scores(train, texts)):
        assert got[k] == pytest.approx(want, rel=1e-6)


def test_filter_never_loses_a_count():
    draw = np.random.default_rng(5)
    keys = draw.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = draw.integers(1, 3000, 20_000)
    bits = np.frombuffer(build_segment(keys & np.uint64(0xFFFFFFFF), counts), np.uint8)
    bloom = LogFrequencyFilter(1, bits, np.zeros(3, np.int64), np.array([len(bits) * 8] * 3))
    want = np.searchsorted(LEAST, counts, side="right")
    read = bloom.levels(keys, 1)
    assert (read >= want).all()  # errors only raise
    assert (read == want).mean() > 0.98 and (np.abs(VALUES[want] / counts - 1) < 0.26).all()
    assert (bloom.levels(draw.integers(0, 1 << 63, 20_000, dtype=np.uint64), 1) > 0).mean() < 0.02


def test_held_out_texts_beat_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn_model(training_rows(docs))
    held = score_texts(docs.subtract(training_rows(docs)), model).selectExpr("sum(score) / sum(n_tokens) AS score", "sum(base_score) / sum(n_tokens) AS base").first()
    assert held.score > held.base + 0.1


def test_empty_model(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = learn_model(empty)
    assert score_texts(empty, model).count() == 0
    row = score_texts(spark.createDataFrame([(None, "a")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)


@pytest.mark.parametrize("filter_bytes", [64 << 20, 64])
def test_words_seen_once_count(spark, filter_bytes):
    rows = spark.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(40)], "doc_id long, text string")
    texts = spark.createDataFrame([(0, "a7 b7 c7"), (1, "a7 c7 b7"), (2, "x y z")], "doc_id long, text string")
    model = learn_model(rows, filter_bytes=filter_bytes)
    got = {r.doc_id: r.score for r in score_texts(texts, model).collect()}
    assert got[0] > got[1] + 1e-3 and got[1] > got[2] + 0.1


def test_the_bound_does_not_change_the_model(spark):
    draw = random.Random(7)
    lines = [" ".join(f"w{int(draw.expovariate(0.02))}" for _ in range(draw.randint(0, 50))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    whole = learn_model(docs, head_words=20)
    parted = learn_model(docs, head_words=20, filter_bytes=64)
    assert whole.whole and not parted.whole
    want = {r.doc_id: r for r in score_texts(docs, whole).collect()}
    got = score_texts(docs, parted, block_bytes=500).collect()
    assert len(got) == len(want) == 402
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-12) and r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-9)


@pytest.mark.parametrize("filter_bytes", [256 << 20, 64])
def test_ngrams_are_looked_up_once(spark, monkeypatch, filter_bytes):
    from clauselake.llm import lm_bloom

    draw, calls, look_up = random.Random(9), [], lm_bloom._looked_up
    docs = spark.createDataFrame([(k, " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(60)))) for k in range(120)] + [(None, None), (7, "w1")], "doc_id long, text string")
    want = sorted(map(tuple, score_texts(docs, learn_model(training_rows(docs), head_words=20, filter_bytes=filter_bytes)).collect()), key=str)
    monkeypatch.setattr(lm_bloom, "_looked_up", lambda *args: calls.append(1) or look_up(*args))
    got = lm_bloom.learn_and_score(docs, lm_bloom.in_training(F.col("doc_id")), head_words=20, filter_bytes=filter_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(calls) == 1


def test_repeated_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 1, 2), (1, "a b c", 3, 4), (None, "a b c", 5, 6), (1, None, 7, 8)], "doc_id long, text string, block long, _text long")
    for filter_bytes in (1 << 20, 8):
        got = score_texts(rows, learn_model(rows, filter_bytes=filter_bytes)).collect()
        assert sorted((r.doc_id is None, r.n_tokens, r.n_known) for r in got) == [(False, 1, 1), (False, 4, 4), (False, 4, 4), (True, 4, 4)]
        assert len({r.score for r in got if r.n_tokens == 4}) == 1


def test_words_that_polynomials_take_for_one(spark):
    from test_common import unlike_words

    one, other = unlike_words()
    model = learn_model(spark.createDataFrame([(0, one)], "doc_id long, text string"))
    got = {r.doc_id: r.n_known for r in score_texts(spark.createDataFrame([(0, one), (1, other)], "doc_id long, text string"), model).collect()}
    assert got == {0: 2, 1: 1}

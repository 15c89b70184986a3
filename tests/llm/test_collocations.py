import collections
import random
import re

import numpy as np

from clauselake.llm import queries
from clauselake.llm.collocations import mine_phrases, phrase_counts

SCHEMA = "doc_id long, text string, lang string, phrase string, f int"


def brute_force(rows, least, longest=5, keep=2000):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        contained = collections.defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    contained[p[i : i + k]] = max(contained[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if contained[p] < a:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[:keep])]
    return sorted(out)


def result(frame, **options):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in mine_phrases(frame, **options).collect())


def texts(draw, n):
    words = [f"w{k}" for k in range(30)] + ["Ä", "ß", "日本", "UP"]
    share = [1 / (k + 1) for k in range(len(words))]
    out = [draw.choice([" ", "  ", "\t", ". ", ",", "\n", "?", "\xa0"]).join(draw.choices(words, share, k=draw.randrange(40))) for _ in range(n)]
    return out + ["new york city is new york city"] * 30 + ["the the the the the the the"] * 9 + [None, "", " ", "...", "one", "A b.A b"]


def test_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["en", "en", "en", "de", None, "und", ""]), t) for t in texts(draw, 500)]
    rows.append(("en", "alpha beta gamma " * 20_000))
    rows.append(("en", "alpha beta, gamma! " * 20_000))
    frame = spark.createDataFrame([(n, t, lang, "clash", 1) for n, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    for least, longest, keep, size, bits in ((3, 5, 2000, 1 << 22, 1 << 29), (3, 5, 7, 2000, 1 << 29), (10, 3, 2000, 100_000, 1 << 29), (5, 2, 50, 1 << 22, 1 << 29), (3, 5, 2000, 1 << 22, 1 << 6)):
        assert result(frame, least=least, longest=longest, keep=keep, shard_bytes=size, most_bits=bits) == brute_force(rows, least, longest, keep)


def test_ties_and_repeated_rows(spark):
    rows = [("en", "b a"), ("en", "a b"), ("en", "c d"), ("en", "d c")] * 4
    frame = spark.createDataFrame([(1, t, lang, "", 0) for lang, t in rows], SCHEMA)
    assert [r[2] for r in result(frame, least=4)] == ["a b", "b a", "c d", "d c"]
    assert result(frame, least=4) == brute_force(rows, 4)


def test_counts_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 4 * 10**9, 7 * 10**9 + 1, 5 * 10**9, 6 * 10**9 + 7
    exact = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * (CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)))) div (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    frame = spark.createDataFrame([(a, n, left, right), (10**16, 10**16, 100, 10**16)], "a long, n long, l long, r long").select(exact)
    assert [r[0] for r in frame.collect()] == [1000 * a * n // (left * right), 1000 * 10**32 // 10**18]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(empty) == []
    counts, totals = phrase_counts(empty)
    assert counts.count() == totals.count() == 0
    assert result(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA)) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in queries.QUERIES["op13_phrases"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute_force([(r.lang, r.text) for r in docs.collect()], 100)
    assert np.all([r[3] >= 100 for r in got])

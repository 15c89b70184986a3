import random
import re

import numpy as np
import pytest
import xxhash

from clauselake.llm import queries
from clauselake.llm.simhash_ball import ball_links, bucket_links, fingerprints, near_duplicate_components

SCHEMA = "doc_id long, text string, fp string, first int"


def fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Union-find over all pairs."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    return [root(x) for x in range(len(fps))]


def brute_force(rows):
    fps = [fingerprint(text) for _, text in rows]
    roots = classes(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)


def result(frame):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicate_components(frame).collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["Ä", "日本", "UPPER", "x" * 50]
    base = [" ".join(draw.choices(words, k=draw.choice([1, 2, 3, 5, 60, 300]))) for _ in range(60)]
    near = [" ".join(w for n, w in enumerate(t.split()) if n != 7) for t in base]
    texts = base + near + base[:10] + [None, "", " \t\n", "a", "A", "a b", "a\x0bb\x0c c  d", " lead and trail ", "long " * 200_000]
    rows = list(enumerate(texts)) + [(3, "another text of the same id"), (None, base[0]), (None, None)]
    draw.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    assert result(frame) == brute_force(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op12_simhash"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


@pytest.mark.parametrize("size", [1 << 8, 1 << 12, 1 << 20])
def test_every_link_within_three_bits_is_on_a_path(spark, size):
    draw = random.Random(size)
    fps = {draw.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for flips in (1, 2, 3, 3, 4):
            g = f
            for b in draw.sample(range(64), flips):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in ball_links(frame, bucket_variants=size).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in links)
    at = {f: n for n, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[root(at[u])] = root(at[v])
    want, got = {}, {}
    for n, r in enumerate(classes(fps)):
        want.setdefault(r, set()).add(n)
    for n in range(len(fps)):
        got.setdefault(root(n), set()).add(n)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_large_buckets_are_cut():
    draw = random.Random(1)
    fps = np.array(sorted({0b1011 ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(300)}), dtype=np.uint64)
    pairs = lambda most: {frozenset(p) for u, v in bucket_links(fps, np.uint64(0), np.uint64(0), most) for p in zip(u.tolist(), v.tolist(), strict=True)}

    def parts(links):
        parent = {f: f for f in fps.tolist()}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in map(tuple, links):
            parent[root(a)] = root(b)
        return {f: root(f) for f in parent}

    few, many = parts(pairs(1 << 30)), parts(pairs(500))
    assert len(set(few.values())) == len(set(many.values())) == 1


def test_empty(spark):
    assert near_duplicate_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(fingerprints(np.zeros(0, np.uint8), np.zeros(1, np.int64), 3)) == 0

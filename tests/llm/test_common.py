import random

import numpy as np
import pyarrow as pa

from clauselake.llm.common import Hasher, connected_components, hash_words, heavy_light_join, text_slices, word_ranges


def unlike_words():
    """Two words of 1,024 letters that hash alike under every polynomial modulo 2^64."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_hashes():
    texts = ["ab  cd", "", "cd\tab\n", "é ab"]
    for first, last, data, offsets in text_slices(pa.array(texts), 5):
        start, end, owner = word_ranges(data, offsets)
        got = [(first + o, data[a:b].tobytes().decode()) for a, b, o in zip(start, end, owner, strict=True)]
        assert got == [(k, w) for k in range(first, last) for w in texts[k].split()]
        hashes = Hasher(data).ranges(start, end)
        again = [Hasher(np.frombuffer(w.encode(), np.uint8)).ranges(np.array([0]), np.array([len(w.encode())]))[0] for _, w in got]
        assert list(hashes) == again
        assert list(hash_words(data, start, end)) == [alone(w) for _, w in got]
    assert len(hash_words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def alone(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return hash_words(data, np.array([0]), np.array([len(data)]))[0]


def test_words_of_all_lengths_hash_by_their_bytes_alone():
    draw = random.Random(7)
    words = {"".join(draw.choices("ab\0z", k=n)) for n in range(1, 140) for _ in range(20)} | {"a" * n for n in range(1, 140)} | {"\0" * n for n in range(1, 140)}
    words = sorted(words)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    got = hash_words(data, starts, ends)
    assert len(set(got.tolist())) == len(words)
    assert [alone(w) for w in words[::17]] == got[::17].tolist()


def test_words_that_polynomials_take_for_one():
    one, other = unlike_words()
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    hashes = hash_words(data, np.array([0, 1025]), np.array([1024, 2049]))
    assert hashes[0] != hashes[1]


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "u long, v long")
    touched = {x for a, b in edges if a != b for x in (a, b)}
    for task_edges in (1_000_000, 50):
        got = {r.node: r.component for r in connected_components(frame, task_edges=task_edges).collect()}
        assert got == {x: find(x) for x in touched}


def test_heavy_light_join(spark):
    left = spark.createDataFrame([(k % 3 if k < 900 else k,) for k in range(1000)], "k long")
    right = left.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice")
    for total in (1000, 10**9):
        got = heavy_light_join(left, right, "k", "n", total).collect()
        assert len(got) == 1000 and all(r.twice == 2 * r.k for r in got)

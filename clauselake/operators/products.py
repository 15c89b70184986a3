"""Sums of products over shared tokens, block by block: a block of chunks and a block of questions meet in one task.

No pair is shuffled. A task numbers tokens, chunks and questions, expands a bounded number
of pairs at a time and sums them; what it holds follows the blocks and not the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.sources.tables import written

#: Pairs of a posting and a question's token that are expanded at a time, but for one question that has more.
PAIRS = 1_000_000
#: Postings and tokens of questions that a task gets, about.
TASK_ROWS = 1 << 17


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    told = pa.concat_arrays(column.chunks).dictionary_encode("encode")
    return told.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(told.dictionary)


def _doubles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are there); nulls are 0."""
    return pc.fill_null(column, 0.0).to_numpy(), pc.is_valid(column).to_numpy()


def _tokens(rows: pa.Table, asked: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of both sides as numbers in their own order, which is the order of each sum."""
    told = pa.concat_arrays([*rows.column("token").chunks, *asked.column("token").chunks]).dictionary_encode()
    rank = np.empty(len(told.dictionary), np.int64)
    rank[pc.sort_indices(told.dictionary).to_numpy()] = np.arange(len(rank))
    codes = rank[told.indices.to_numpy()]
    return codes[: rows.num_rows], codes[rows.num_rows :], len(rank)


def _parts(ends: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of asked rows that end with a question and have about ``PAIRS`` pairs at most."""
    done, before = 0, 0
    while done < ends[-1]:
        fits = ends[np.searchsorted(pairs[ends - 1], before + PAIRS, "right") - 1] if pairs[ends[0] - 1] <= before + PAIRS else 0
        upto = int(fits) if fits > done else int(ends[np.searchsorted(ends, done, "right")])
        yield done, upto
        done, before = upto, int(pairs[upto - 1])


def _among(group: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are not behind the ``k``-th of their group; those of a group lie together."""
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    keep = np.ones(len(group), bool)
    for a, b in zip(edges, edges[1:]):
        if b - a > k:
            keep[a:b] = down[a:b] <= np.partition(down[a:b], k - 1)[k - 1]
    return np.flatnonzero(keep)


def _sums(k: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        first = questions = np.zeros(0, np.int64)
        if rows.num_rows and asked.num_rows:
            tokens, theirs, n_tokens = _tokens(rows, asked)
            (ids, n_ids), (kinds, n_kinds) = _codes(rows.column("chunk_id")), _codes(rows.column("corpus_type"))
            _, first, chunk = np.unique(kinds * n_ids + ids, return_index=True, return_inverse=True)
            kind, place = kinds[first], np.empty(len(first), np.int64)
            place[pc.sort_indices(rows.column("chunk_id").take(pa.array(first))).to_numpy()] = np.arange(len(first))
            _, questions, question = np.unique(_codes(asked.column("query_id"))[0], return_index=True, return_inverse=True)
            (weight, sound), (w, given) = _doubles(rows.column("weight")), _doubles(asked.column("w"))
            by_token = np.argsort(tokens, kind="stable")
            starts = np.searchsorted(tokens[by_token], np.arange(n_tokens + 1))
            turn = np.lexsort((w, theirs, question))
            question, theirs, w, given = question[turn], theirs[turn], w[turn], given[turn]
            counts = starts[theirs + 1] - starts[theirs]
            pairs = np.cumsum(counts)
            ends = np.append(np.flatnonzero(np.diff(question)) + 1, len(question))
            for a, b in _parts(ends, pairs):
                own = np.repeat(np.arange(a, b), counts[a:b])
                at = by_token[np.arange(len(own)) + pairs[a] - counts[a] - (pairs - counts)[own] + starts[theirs[own]]]
                both, pair = np.unique(question[own] * len(first) + chunk[at], return_inverse=True)
                there = sound[at] & given[own]
                score = np.bincount(pair, np.where(there, w[own] * weight[at], 0.0), len(both))
                some = np.bincount(pair, there, len(both)) > 0
                q, c = np.divmod(both, max(1, len(first)))
                if k is not None:
                    down = np.where(some, np.where(np.isnan(score), -np.inf, -score), np.inf)
                    order = _among(q * n_kinds + kind[c], down, k)
                    order = order[np.lexsort((place[c[order]], down[order], kind[c[order]], q[order]))]
                    group = (q * n_kinds + kind[c])[order]
                    order = order[np.arange(len(group)) - np.searchsorted(group, group) < k]
                    q, c, score, some = q[order], c[order], score[order], some[order]
                found.append((q, c, score, some))
        q, c, score, some = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
        own, whose = pa.array(first[c]), pa.array(questions[q])
        return pa.table({"query_id": asked.column("query_id").take(whose), "chunk_id": rows.column("chunk_id").take(own), "corpus_type": rows.column("corpus_type").take(own), "score": pa.array(score, mask=~some)})

    return run


def sums(postings: DataFrame, queries: DataFrame, k: int | None = None, *, chunk_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, chunk_id, corpus_type, score) of every pair with a shared token; with ``k``, of a block's best of each question and corpus.

    ``postings``: (token, chunk_id, corpus_type, weight); ``queries``: (query_id, sparse), a
    map of weights by token. Rows of equal keys add up. ``chunk_block`` postings and
    ``query_block`` tokens of questions are about what meets in one task; without ``k`` the
    blocks are small, as every pair is returned.
    """
    chunk_block, query_block = chunk_block or (1 << 14 if k is None else 1 << 18), query_block or (1 << 10 if k is None else 1 << 12)
    token = postings.schema["token"].dataType
    rows = written(postings.where("token IS NOT NULL").select(F.col("token").alias("token"), "chunk_id", "corpus_type", F.col("weight").cast("double").alias("weight")), "postings")
    asked = written(queries.select("query_id", F.explode("sparse").alias("token", "w")).select("query_id", F.col("token").cast(token).alias("token"), F.col("w").cast("double").alias("w")), "asked")
    n_rows, n_asked = rows.count(), asked.count()
    n, m = max(1, -(-n_rows // chunk_block)), max(1, -(-n_asked // query_block))
    blocks = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = rows.select("*", F.pmod(F.xxhash64("chunk_id", "corpus_type"), F.lit(n)).cast("int").alias("_c"), blocks(m).alias("_q"))
    put = asked.select("*", blocks(n).alias("_c"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("_q"))
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, corpus_type {types['corpus_type']}, score double"
    # Partitions follow what is sent, so that what a task sorts does not; more than twice the meetings would be empty.
    parts = min(2 * n * m, -(-(n_rows * m + n_asked * n) // TASK_ROWS) or 1)
    apart = lambda df: df.repartition(parts, "_c", "_q").groupBy("_c", "_q")
    return apart(dealt).cogroup(apart(put)).applyInArrow(_sums(k), schema)

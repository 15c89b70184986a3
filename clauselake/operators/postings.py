"""Sparse search that stops early, exactly: postings by impact in blocks, read from the strongest down.

The list of a token in a corpus is ordered by weight and cut into blocks, each with its
greatest weight. A chunk in no block read so far has, for each token of a question, at
most the greatest weight of the first block not read. While the sum of these could still
be among the best, more blocks are read; then the question is done, and most of its lists
were never touched. What was met is scored in full from the chunks' own vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.sources.tables import written


@dataclass(frozen=True)
class ImpactIndex:
    """blocks: (token, corpus_type, part, block, top, chunk_ids). vectors: (chunk_id, corpus_type, weights), a map by token."""

    blocks: DataFrame
    vectors: DataFrame


def build_index(postings: DataFrame, block_rows: int = 128, part_rows: int = 1_000_000) -> ImpactIndex:
    """The index of ``postings`` (token, chunk_id, corpus_type, weight); both tables are written to the shared folder.

    Weights of a repeated token and chunk add up. Weights that are null or not above 0 take
    no part. Lists above ``part_rows`` are dealt to parts by chunk, each in its own order,
    so that no task sorts the list of a token that a third of all chunks have.
    """
    key = ["token", "corpus_type"]
    summed = written(postings.where("token IS NOT NULL AND weight > 0").groupBy(*key, "chunk_id").agg(F.sum(F.col("weight").cast("double")).alias("weight")), "postings")
    parts = summed.groupBy(*key).agg(F.ceil(F.count("*") / part_rows).alias("_parts"))
    dealt = summed.join(parts, key).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int"))
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.desc("weight"), "chunk_id")) - 1
    blocks = dealt.withColumn("block", F.floor(place / block_rows).cast("int")).groupBy(*key, "part", "block").agg(F.max("weight").alias("top"), F.collect_list("chunk_id").alias("chunk_ids"))
    vectors = summed.groupBy("chunk_id", "corpus_type").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
    return ImpactIndex(written(blocks, "blocks"), written(vectors, "vectors"))


def sparse_best(index: ImpactIndex, queries: DataFrame, k: int, shown: DataFrame | None = None, tally: list[int] | None = None) -> DataFrame:
    """(query_id, chunk_id, corpus_type, score, rank): the ``k`` best sums of products of each question in each corpus.

    ``queries``: (query_id, sparse), a map of weights by token; those that are null or not
    above 0 take no part. ``shown``: the chunk_ids that may be found. Chunks without a
    shared token are never found. Ties go to the smaller chunk_id. Each round reads twice
    as many blocks of a list as all rounds before, and is written to the shared folder;
    ``tally`` gets the number of blocks that each has read.
    """
    asked = written(queries.select("query_id", F.explode("sparse").alias("token", "w")).where("w > 0").withColumn("w", F.col("w").cast("double")), "asked")
    wanted = queries.select("query_id", F.col("sparse").alias("_q"))
    pair = ["query_id", "corpus_type"]
    place = F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("score"), "chunk_id"))
    lists = asked.join(index.blocks.select("token", "corpus_type", "part", "block", "top"), "token")
    score = F.aggregate(F.map_entries("_q"), F.lit(0.0), lambda s, e: s + F.when(e["value"] > 0, e["value"] * F.coalesce(F.try_element_at("weights", e["key"]), F.lit(0.0))).otherwise(0.0))
    open_, best, low, high = lists.select(*pair).distinct(), None, 0, 1
    while True:
        reads = written(asked.join(open_, "query_id").join(index.blocks.where(f"block >= {low} AND block < {high}").drop("top"), ["token", "corpus_type"]).select(*pair, "chunk_ids"), "reads")
        if tally is not None:
            tally.append(reads.count())
        met = reads.select(*pair, F.explode("chunk_ids").alias("chunk_id")).distinct()
        met = met if shown is None else met.join(shown.select("chunk_id"), "chunk_id", "left_semi")
        scored = met.join(index.vectors, ["chunk_id", "corpus_type"]).join(wanted, "query_id").select(*pair, "chunk_id", score.alias("score"))
        # A chunk met again by a later block of another token is there already.
        every = scored if best is None else scored.unionByName(best.drop("rank")).distinct()
        best = written(every.withColumn("rank", place).where(F.col("rank") <= k), "best")
        unread = lists.where(F.col("block") == high).groupBy(*pair, "token", "w").agg(F.max("top").alias("top")).groupBy(*pair).agg(F.sum(F.col("w") * F.col("top")).alias("_most"))
        kth = best.groupBy(*pair).agg(F.when(F.count("*") >= k, F.min("score")).alias("_kth"))
        # Sums of products in another order may differ in their last digits.
        open_ = written(unread.join(kth, pair, "left").where("_kth IS NULL OR _most * (1 + 1e-12) >= _kth").select(*pair), "open")
        if open_.isEmpty():
            return best
        low, high = high, 3 * high

"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, jaccard_join, langid, lm_bloom, mixing, quality, sharding, simhash_ball, suffix_dedup, topk, warc
from .common import fold_of
from .oracle import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), span=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs, folds=5, held_out_fold=0)
    return langid.identify_languages(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = lm_bloom.learn_and_score(docs, lm_bloom.in_training(F.col("doc_id"), folds=5, held_out_fold=1))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100, count_links=True)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_targets(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranker = quality.learn_quality(docs, _table(spark, sf_dir, "labels"), folds=4, held_out_fold=2, cut=0.7)
    return quality.score_quality(docs, ranker).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=40)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine_negatives(vectors, anchor_every=100, positives=5, negatives=5, num=80, den=100)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicate_components(_table(spark, sf_dir, "documents"), width=3).select("doc_id", "fingerprint", "component_id")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"), least=100, longest=5, keep=2000)


QUERIES = {f.__name__: f for f in (op1_warc, op2_topk, op3_suffix, op4_langid, op5_lm, op6_jaccard, op7_mix, op8_decontaminate, op9_quality, op10_shard, op11_negatives, op12_simhash, op13_phrases)}

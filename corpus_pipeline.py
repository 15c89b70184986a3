"""A training corpus from raw documents: five stages, each one written and read again.

Quality ranking, near-duplicate removal, benchmark decontamination, mixing sources to
target weights, sharding. Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm.common import cut, fresh_path
from clauselake.llm.decontaminate import find_contamination
from clauselake.llm.jaccard_join import similar_components
from clauselake.llm.mixing import mix_to_targets
from clauselake.llm.quality import learn_quality, score_quality
from clauselake.llm.sharding import shard_documents

#: Marked ids are broadcast up to this number, and joined by a shuffle beyond it.
MOST_BROADCAST = 1_000_000
#: Keys of null ids, and of texts that share their id, are below this.
OWN_KEYS = -(1 << 62)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality ranking rejects (score under 0.7)."""
    ranker = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, held_out_fold=2, cut=0.7)
    return score_quality(docs, ranker, carry=docs.columns).where("predicted = 1").select("carried.*")


def _own_keys(docs: DataFrame) -> DataFrame:
    """(_id, _hash, _own): a key below OWN_KEYS for each distinct text of null ids, of ids that carry several texts, and of ids in that range."""
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    several = texts.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_hash").alias("_low"), F.max("_hash").alias("_high")).where("_low <> _high").select("_id")
    found = texts.join(several, "_id", "left_semi").union(texts.where(F.col("_id").isNull() | (F.col("_id") < OWN_KEYS))).distinct()
    return cut(found.withColumn("_own", F.lit(OWN_KEYS - 1) - F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of smallest id, of each class of 5-word shingle similarity 0.8.

    A document is a distinct pair of id and text, so texts that share an id are decided
    apart; of those in one class the smallest text hash stays. Rows with a null id are
    told apart by their text and come before all ids. Of rows that repeat both id and
    text one stays. Documents without words have no near-duplicates.
    """
    own = _own_keys(docs)
    n_own = own.count()
    small = F.broadcast(own) if n_own <= MOST_BROADCAST else own
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    if n_own:
        rows = rows.join(small.withColumnsRenamed({"_id": "_own_id", "_hash": "_own_hash"}), F.col("_id").eqNullSafe(F.col("_own_id")) & (F.col("_hash") == F.col("_own_hash")), "left")
    rows = rows.select((F.coalesce("_own", "_id") if n_own else F.col("_id")).alias("_key"), "_row")
    classes = similar_components(rows.select(F.col("_key").alias("doc_id"), "_row.text"), width=5, num=80, den=100)
    ids = cut(classes.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("_least"), F.count("*").alias("_rows")))
    # Keys of one's own are below all others, so a class that holds one shows it as its least.
    marked = ids.where(F.col("_least") >= OWN_KEYS).where("_least < _key OR _rows > 1").select("_key", (F.col("_least") < F.col("_key")).alias("_drop"))
    if n_own:
        mixed = ids.where(F.col("_least") < OWN_KEYS).join(own.withColumnRenamed("_own", "_key"), "_key", "left")
        mixed = cut(mixed.select("_key", "_least", "_rows", F.struct(F.coalesce("_id", "_key").alias("_id"), "_hash", "_key").alias("_place")))
        stay = mixed.groupBy("_least").agg(F.min("_place").alias("_place")).select(F.col("_place._key").alias("_key"), F.lit(False).alias("_drop"))
        mixed = mixed.join(stay, "_key", "left").select("_key", F.coalesce("_drop", F.lit(True)).alias("_drop"), "_rows")
        marked = marked.union(mixed.where("_drop OR _rows > 1").select("_key", "_drop"))
    marked = F.broadcast(marked) if marked.count() <= MOST_BROADCAST else marked
    rows = rows.join(marked, "_key", "left")
    repeated = rows.where("NOT _drop").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    return rows.where("_drop IS NULL").select("_row.*").union(repeated.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a 10-word window of a benchmark item."""
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, carry=tuple(docs.columns)).where("n_hit = 0").select("carried.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents taken no time go."""
    mixed = mix_to_targets(docs, weights=(5, 2, 1), cap=3, carry=docs.columns)
    return mixed.where("copies > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")


#: What sharding adds; columns of documents that have these names go on with ``doc_`` before them.
SHARD_COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the corpus into 40 shards of near-equal bytes, all columns of documents included."""
    others = [c for c in docs.columns if c != "doc_id"]
    names = set(others) | set(SHARD_COLUMNS)
    named = []
    for c in others:
        name = c
        while name in SHARD_COLUMNS or (name != c and name in names):
            name = f"doc_{name}"
        names.add(name)
        named.append(F.col(f"carried.`{c}`").alias(name))
    return shard_documents(docs, n_shards=40, carry=others).select("doc_id", *SHARD_COLUMNS, *named)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: A fitted ranking, tilts and bin packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs

"""Tables of the engine as Parquet: reading by key, keyed upserts, partition replacement, dictionaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the dictionaries.
DICTIONARIES = {
    "issuers": ("code", "name", "issuer_level"),
    "aliases": ("alias", "canonical_doc_number", "canonical_title", "dict_version"),
    "biz_domains": ("code", "name", "parent_code"),
    "departments": ("code", "name", "dict_version"),
    "entity_types": ("code", "name", "dict_version"),
    "violation_types": ("code", "name", "dict_version"),
    "scenario_terms": ("oral_term", "legal_terms"),
}
KEYS = {"aliases": "alias", "scenario_terms": "oral_term"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only a local session may make one itself."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="clauselake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, with or without a byte-order mark."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as CSV; empty cells are empty strings, lines without any value are left out."""
    rows = _csv(spark, path).na.fill("")
    return rows.where(F.concat_ws("", *rows.columns) != "")


def dictionary(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dictionary as CSV in the columns that it must have; empty cells are null. Later lines of a key are dropped."""
    columns = DICTIONARIES[name]
    key = KEYS.get(name, "code")
    # Ids rise with the lines of a file.
    rows = _csv(spark, path).select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns], F.monotonically_increasing_id().alias("_line")).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), "_line").alias("_r")).select("_r.*")


def scenario_terms(terms: DataFrame) -> DataFrame:
    """(ord, oral_term, legal_terms array) of the scenario dictionary."""
    from pyspark.sql import Window

    listed = F.filter(F.transform(F.split("legal_terms", r"[|]"), lambda t: F.trim(t)), lambda t: t != "")
    return terms.withColumn("legal_terms", listed).where("oral_term IS NOT NULL AND size(legal_terms) > 0").withColumn("ord", F.row_number().over(Window.orderBy("oral_term")))


def upsert(current: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """``current`` with the rows of equal keys replaced by ``fresh``; columns that one side lacks are null."""
    return current.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge(current: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """``current`` with non-null values of ``fresh`` put in by key, and new keys added."""
    both = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("_c")).join(fresh.select(*keys, F.struct(*[c for c in fresh.columns if c not in keys]).alias("_f")), list(keys), "full_outer")
    value = lambda c: F.coalesce(*([F.col(f"_f.{c}")] if c in fresh.columns else []), F.col(f"_c.{c}")).alias(c)
    return both.select(*keys, *[value(c) for c in current.columns if c not in keys])


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df``, replacing just the partitions that it has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes unless something is there already."""
    df.write.mode("ignore").parquet(path)


def object_keys(versions: DataFrame) -> DataFrame:
    """Adds the keys of a version's raw file, rendition and parsed form."""
    return versions.withColumns({
        "raw_key": F.concat_ws("/", F.lit("raw"), "corpus_type", "batch_id", F.concat_ws(".", "version_id", "source_format")),
        "rendition_key": F.concat(F.lit("rendition/"), "version_id", F.lit(".pdf")),
        "ir_key": F.concat(F.lit("ir/"), "version_id", F.lit(".json")),
    })

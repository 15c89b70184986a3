"""Queries of stored records: vectors as bytes, cited regulations, parents, pages, batches, threads, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import codec, text as X
from clauselake.operators import alignment, conversations, curation, references, report, retrieval, sketches
from clauselake.sources import tables
from clauselake.sources.corpus import conversation_messages, table

from . import retrieval as questions
from .text import _pages, _SOLID

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# Bytes of a float32 from its bits: the hex of the number, its four bytes turned round.
_HEX = "list_transform(list_transform(embedding, lambda x: lpad(hex(CAST(CAST(CAST(x AS FLOAT) AS BIT) AS UINTEGER)), 8, '0')), lambda h: substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))"


@query(f"""SELECT vec_id, array_to_string({_HEX}, '') AS dense, len(embedding) AS dims, TRUE AS same, [vec_id % 97, vec_id % 89 + 1000] AS tokens, [1.0 + vec_id % 5, 2.0] AS weights FROM embeddings WHERE embedding IS NOT NULL""")
def vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    sparse = F.create_map(F.col("vec_id") % 97, (F.col("vec_id") % 5 + 1).cast("double"), F.col("vec_id") % 89 + 1000, F.lit(2.0))
    packed = rows.select("vec_id", "embedding", codec.dense_bytes(F.col("embedding")).alias("_d"), codec.sparse_bytes(sparse).alias("_s"))
    read = packed.select("vec_id", "embedding", "_d", codec.dense_vector(F.col("_d")).alias("_v"), codec.numbered_tokens(codec.sparse_vector(F.col("_s"))).alias("_m"))
    entries = F.array_sort(F.map_entries("_m"))
    return read.select("vec_id", F.hex("_d").alias("dense"), F.size("_v").cast("long").alias("dims"), (F.col("_v") == F.col("embedding").cast("array<float>")).alias("same"), F.transform(entries, lambda e: e["key"]).alias("tokens"), F.transform(entries, lambda e: e["value"]).alias("weights"))


@query("""WITH a AS (SELECT l_orderkey AS case_id, l_linenumber AS ord, 'n' || (l_partkey % 9) AS no, 't' || l_partkey AS title, l_linenumber % 3 <> 0 AS ok FROM lineitem)
SELECT case_id, string_agg(no || ' ' || title || ' ' || CASE WHEN ok THEN '1/' || ord ELSE '-' END || ' ' || ok, ', ' ORDER BY ord, no, title) AS cited, NOT bool_and(ok) AS ref_unresolved FROM a GROUP BY 1""")
def citations_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ok = F.col("l_linenumber"), F.col("l_linenumber") % 3 != 0
    aligned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), k.alias("ord"), F.concat(F.lit("n"), (F.col("l_partkey") % 9).cast("string")).alias("doc_no"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("title"), F.when(ok, F.concat(F.lit("1/"), k.cast("string"))).alias("clause_path_norm"), ok.alias("resolved"))
    said = lambda e: F.concat_ws(" ", e["doc_no"], e["title"], F.coalesce(e["clause_path_norm"], F.lit("-")), e["resolved"].cast("string"))
    return references.citation_arrays(aligned).select("case_id", F.array_join(F.transform("cited_regulations", said), ", ").alias("cited"), "ref_unresolved")


@query(f"""WITH {questions._CORPUS}, k AS (SELECT *, CASE WHEN chunk_id % 4 <> 0 THEN chunk_id - chunk_id % 4 END AS parent FROM chunks),
p AS (SELECT a.chunk_id, b.text AS parent_text FROM k a JOIN k b ON a.parent = b.chunk_id)
SELECT query_id, place, c.chunk_id, k.clause_path, k.page_start, k.text AS chunk_text, p.parent_text, 'doc ' || k.version_id AS doc_title FROM cands c JOIN k USING (chunk_id) LEFT JOIN p USING (chunk_id)""")
def clause_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("chunk_id")
    chunks = questions._chunks(spark, sf_dir).withColumn("parent_chunk_id", F.when(i % 4 != 0, i - i % 4))
    cited = retrieval.citations(questions._candidates(spark, sf_dir), chunks, questions._versions(spark, sf_dir))
    return cited.join(retrieval.parent_texts(chunks), "chunk_id", "left").select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "clause_path", "page_start", "chunk_text", "parent_text", "doc_title")


def _offset_sql() -> str:
    from clauselake.sources.corpus import REGULATION_SQL

    return f"""WITH {REGULATION_SQL}, p AS (SELECT version_id, page, sum(length({_SOLID})) AS n FROM blocks GROUP BY 1, 2),
o AS (SELECT version_id, page, sum(n) OVER w - n AS a, sum(n) OVER w AS b FROM p WINDOW w AS (PARTITION BY version_id ORDER BY page)),
e AS (SELECT version_id, max(b) AS b, max(page) AS last FROM o GROUP BY 1),
x AS (SELECT version_id, CAST(unnest([0, version_id % 300, 2000, b + 5]) AS BIGINT) AS "offset", b, last FROM e)
SELECT x.version_id, x."offset", CAST(coalesce(o.page, x.last) AS INTEGER) AS page_no FROM x LEFT JOIN o ON o.version_id = x.version_id AND least(x."offset", x.b - 1) >= o.a AND least(x."offset", x.b - 1) < o.b"""


@query(_offset_sql())
def pages_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = alignment.page_offsets(_pages(spark, sf_dir))
    ends = offsets.groupBy("version_id").agg(F.max("end").alias("_b"))
    asked = ends.select("version_id", F.explode(F.array(F.lit(0).cast("long"), F.col("version_id") % 300, F.lit(2000).cast("long"), F.col("_b") + 5)).alias("offset"))
    return alignment.pages_at(offsets, asked)


@query("""WITH d AS (SELECT o_custkey % 20 AS batch_id, CASE o_orderstatus WHEN 'O' THEN 'INDEXED' WHEN 'F' THEN 'QC_FAILED' ELSE 'META_REVIEW' END AS s, o_orderdate AS day FROM orders),
c AS (SELECT batch_id, s, count(*) AS n FROM d GROUP BY 1, 2),
l AS (SELECT arg_max(batch_id, (newest, batch_id)) AS latest FROM (SELECT batch_id, max(day) AS newest FROM d GROUP BY 1))
SELECT batch_id, string_agg(s || ' ' || n, ', ' ORDER BY s) AS statuses, CAST(sum(n) AS BIGINT) AS docs, batch_id = any_value(latest) AS is_latest FROM c, l GROUP BY 1""")
def report_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "INDEXED").when(F.col("o_orderstatus") == "F", "QC_FAILED").otherwise("META_REVIEW")
    docs = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("batch_id"), state.alias("pipeline_status"), F.col("o_orderdate").alias("at"))
    latest = report.latest_batch(docs.groupBy("batch_id").agg(F.max("at").alias("created_at"))).select(F.col("batch_id").alias("_latest"))
    told = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")
    rows = report.batch_statuses(docs).select("batch_id", told.alias("statuses"), "docs")
    return rows.join(latest, F.col("batch_id") == F.col("_latest"), "left").select("batch_id", "statuses", "docs", F.col("_latest").isNotNull().alias("is_latest"))


@query(f"""WITH {questions._CORPUS}, k AS (SELECT vec_id AS chunk_id, vec_id - vec_id % 2 AS version_id FROM embeddings), v AS (SELECT DISTINCT version_id FROM k),
h AS (SELECT version_id, min(place) AS rank FROM cands JOIN k USING (chunk_id) WHERE query_id = version_id GROUP BY 1)
SELECT version_id, rank IS NOT NULL AS hit, rank FROM v LEFT JOIN h USING (version_id)""")
def verify_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    chunks = table(spark, sf_dir, "embeddings").select(i.alias("chunk_id"), (i - i % 2).alias("version_id"))
    return report.smoke(questions._candidates(spark, sf_dir), chunks.select("version_id").distinct(), chunks).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT DISTINCT conv_id AS conversation_id FROM conversations WHERE conv_id % 3 <> 1)
SELECT c.conversation_id, string_agg(turn || ' ' || role || ' ' || md5(coalesce(text, '')), ',' ORDER BY turn) AS messages FROM c JOIN conversations ON conv_id = conversation_id GROUP BY 1""")
def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversation_messages(spark, sf_dir)
    every = messages.select("conversation_id").distinct()
    kept, left = conversations.delete(every, messages, every.where("conversation_id % 3 = 1"))
    said = lambda m: F.concat_ws(" ", m["seq"].cast("string"), m["role"], F.md5(F.coalesce(m["content"], F.lit(""))))
    return conversations.threads(kept, left).select("conversation_id", F.array_join(F.transform("messages", said), ",").alias("messages"))


@query("""WITH f AS (SELECT p_partkey, p_name || '_2024-0' || (1 + p_partkey % 9) || '-1' || (p_partkey % 10) || '_银发〔20' || (10 + p_partkey % 15) || '〕' || (p_partkey % 300) || '号 ' || p_brand || '.pdf' AS n FROM part)
SELECT p_partkey, DATE '2024-01-10' + INTERVAL (p_partkey % 9) MONTH + INTERVAL (p_partkey % 10) DAY AS issue_date, '银发〔20' || (10 + p_partkey % 15) || '〕' || (p_partkey % 300) || '号' AS doc_number,
  left(regexp_replace(left(n, length(n) - 4), '[^\\p{L}\\p{N}._-]+', '_', 'g'), 70) AS stem, '一二入' || p_partkey AS unified FROM f""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit("_2024-0"), (k % 9 + 1).cast("string"), F.lit("-1"), (k % 10).cast("string"), F.lit("_银发〔20"), (k % 15 + 10).cast("string"), F.lit("〕"), (k % 300).cast("string"), F.lit("号 "), "p_brand", F.lit(".pdf"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    radicals = F.concat(F.lit("⼀⼆⼊"), F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", curation.file_hints(F.col("n")).alias("h"), curation.safe_stem(F.col("n")).alias("stem"), X.unify_radicals(radicals).alias("unified")).select("p_partkey", F.col("h.issue_date").cast("timestamp_ntz").alias("issue_date"), "h.doc_number", "stem", "unified")


# The exact form beside the merged sketches: a median is near if about half of the values lie on either side of it.
@query("""SELECT l_returnflag AS by_flag, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS greatest, TRUE AS median_near, TRUE AS keys_near FROM lineitem GROUP BY 1""")
def report_spread_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("by_flag"), (F.col("l_orderkey") % 16).alias("batch"), "l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    kept = tables.written(sketches.of_batches(lines, "l_quantity", "l_orderkey", "by_flag", "batch"), "sketches")
    found = sketches.spread(kept, "by_flag").withColumnRenamed("median", "_m").withColumnRenamed("distinct_keys", "_k")
    ranked = lines.join(F.broadcast(found.select("by_flag", "_m", "_k")), "by_flag").groupBy("by_flag").agg(F.avg((F.col("l_quantity") < F.col("_m")).cast("double")).alias("_under"), F.avg((F.col("l_quantity") <= F.col("_m")).cast("double")).alias("_upto"), F.countDistinct("l_orderkey").alias("_exact"))
    near = (F.col("_under") <= 0.51) & (F.col("_upto") >= 0.49)
    return found.join(ranked, "by_flag").select("by_flag", "n", "least", "greatest", near.alias("median_near"), (F.abs(F.col("_k") - F.col("_exact")) <= 0.08 * F.col("_exact")).alias("keys_near"))


@query("""WITH i AS (SELECT l_orderkey AS version_id, 'q' || l_linenumber AS key, l_quantity AS value, l_quantity >= 5 AS passed FROM lineitem), l AS (SELECT o_orderkey AS version_id, o_orderstatus = 'F' AS good FROM orders)
SELECT key, min(value) AS least, max(value) AS greatest, count(*) FILTER (NOT passed) AS fails, count(*) FILTER (good AND NOT passed) AS good_failed, count(*) FILTER (NOT good AND passed) AS bad_passed,
  CASE WHEN count(*) FILTER (good AND NOT passed) >= 2 THEN 'loosen' WHEN count(*) FILTER (NOT good AND passed) >= 2 THEN 'tighten' END AS advice FROM i JOIN l USING (version_id) GROUP BY 1""")
def report_thresholds_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") == "F").alias("good"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.concat(F.lit("q"), "l_linenumber").alias("key"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_suppkey") % 8).alias("batch"))
    flags = sketches.threshold_flags(F.col("good"), F.col("value") >= 5)
    kept = tables.written(sketches.of_batches(lines.join(labels, "version_id"), "value", "version_id", "key", "batch", flags=flags), "sketches")
    return sketches.threshold_advice(kept).drop("median")

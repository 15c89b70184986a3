"""Engine inputs made from the star-schema tables, the same way in Spark and in SQL.

``regulation_lines`` gives plain documents the shape of regulations: every line becomes a
block, and its place in the document decides the heading and the words put before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")
WORDS = ("应当", "不得", "责令", "相应", "无须", "应", "可以", "须经", "有义务", "对应当")
SPANS = ("三十日", "5个工作日", "半年", "两个月", "次年", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chinese(n: Column) -> Column:
    """A number from 1 to 9999 in Chinese digits and units, zeros left out."""
    digits = F.array(*map(F.lit, DIGITS))
    place = lambda unit, name: F.when(F.floor(n / unit) % 10 > 0, F.concat(F.get(digits, (F.floor(n / unit) % 10).cast("int")), F.lit(name))).otherwise("")
    return F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, ""))


def regulation_lines(docs: DataFrame) -> DataFrame:
    """Blocks (version_id, idx, kind, text, page, page_end) of ``documents``.

    Of 12 lines the first opens a chapter and the seventh a section, each third (from the
    second) an article, the sixth is an item and the ninth a sub-item; words of duty and
    durations come in turn. Pages have 5 lines.
    """
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("version_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    i, k = F.col("idx"), (F.col("version_id") + F.col("idx")).cast("int")
    word = F.get(F.array(*map(F.lit, WORDS)), F.pmod(k, F.lit(len(WORDS))))
    span = F.get(F.array(*map(F.lit, SPANS)), F.pmod(k, F.lit(len(SPANS))))
    label = (
        F.when(i % 12 == 0, F.concat(F.lit("第"), chinese(F.floor(i / 12) + 1), F.lit("章 ")))
        .when(i % 12 == 6, F.concat(F.lit("第"), chinese(F.floor(i / 12) + 1), F.lit("节 ")))
        .when(i % 3 == 1, F.concat(F.lit("第"), chinese(F.floor(i / 3) + 1), F.lit("条 ")))
        .when(i % 12 == 5, F.lit("（二）"))
        .when(i % 12 == 8, F.lit("③"))
        .otherwise("")
    )
    page = (F.floor(i / 5) + 1).cast("int")
    return lines.select("version_id", "idx", F.lit("text").alias("kind"), F.concat(label, word, span, F.lit(" "), F.col("line")).alias("text"), page.alias("page"), F.lit(None).cast("int").alias("page_end"))


REGULATION_SQL = f"""
lines AS (
  SELECT doc_id AS version_id, unnest(range(len(parts))) AS idx, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL)
),
numbered AS (SELECT *, idx // 12 + 1 AS c, idx // 3 + 1 AS a, (version_id + idx) AS k FROM lines),
digits AS (SELECT {list(DIGITS)} AS d),
named AS (
  SELECT n.*,
    {{c}} AS cn, {{a}} AS an
  FROM numbered n, digits
),
blocks AS (
  SELECT version_id, CAST(idx AS INT) AS idx,
    CASE WHEN idx % 12 = 0 THEN '第' || cn || '章 ' WHEN idx % 12 = 6 THEN '第' || cn || '节 ' WHEN idx % 3 = 1 THEN '第' || an || '条 '
      WHEN idx % 12 = 5 THEN '（二）' WHEN idx % 12 = 8 THEN '③' ELSE '' END
    || ({list(WORDS)})[1 + k % {len(WORDS)}] || ({list(SPANS)})[1 + k % {len(SPANS)}] || ' ' || line AS text,
    CAST(idx // 5 + 1 AS INT) AS page
  FROM named
)"""


def _chinese_sql(n: str) -> str:
    place = lambda unit, name: f"CASE WHEN {n} // {unit} % 10 > 0 THEN d[1 + {n} // {unit} % 10] || '{name}' ELSE '' END"
    return " || ".join(place(*p) for p in ((1000, "千"), (100, "百"), (10, "十"), (1, "")))


REGULATION_SQL = REGULATION_SQL.format(c=_chinese_sql("c"), a=_chinese_sql("a"))


def case_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cases, versions): an order is a case, its customer the document behind it."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("version_id"), F.concat(F.lit("局"), F.col("o_orderpriority")).alias("penalty_org"), F.to_date("o_orderdate").alias("penalty_date"), F.when(F.col("o_orderkey") % 3 == 0, "个人").otherwise("机构").alias("respondent_type"), F.nullif("o_orderstatus", F.lit("P")).alias("violation_category"), F.lit("罚款").alias("penalty_type"), (F.col("o_totalprice") / 10000).alias("amount_wan"))
    state = F.when(F.col("c_custkey") % 10 == 0, "DEGRADED_INDEXED").otherwise("INDEXED")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "superseded").otherwise("effective")
    versions = customers.select(F.col("c_custkey").alias("version_id"), F.col("c_name").alias("title"), state.alias("pipeline_status"), status.alias("version_status"))
    return cases, versions


CASE_SQL = """
cases AS (
  SELECT o_orderkey AS case_id, o_custkey AS version_id, '局' || o_orderpriority AS penalty_org, CAST(o_orderdate AS DATE) AS penalty_date,
    CASE WHEN o_orderkey % 3 = 0 THEN '个人' ELSE '机构' END AS respondent_type, nullif(o_orderstatus, 'P') AS violation_category, '罚款' AS penalty_type, o_totalprice / 10000 AS amount_wan
  FROM orders
),
versions AS (
  SELECT c_custkey AS version_id, c_name AS title, CASE WHEN c_custkey % 10 = 0 THEN 'DEGRADED_INDEXED' ELSE 'INDEXED' END AS pipeline_status,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'superseded' ELSE 'effective' END AS version_status
  FROM customer
)"""

STATES = ("REGISTERED", "PARSING", "QC_PENDING", "STRUCTURING", "QC_FAILED", "META_REVIEW", "EMBEDDING", "INDEXING", "INDEXED")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline events (id, version_id, to_state, error_code, at) from ``events``: a user is a document."""
    events = table(spark, sf_dir, "events")
    state = F.get(F.array(*map(F.lit, STATES)), F.pmod(F.crc32(F.concat_ws("|", "event_type", (F.col("event_id") % 7).cast("string"))), F.lit(len(STATES))).cast("int"))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("version_id"), state.alias("to_state"), F.when(state == "QC_FAILED", "E301").alias("error_code"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("route"))


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector corpus (chunk_id, corpus_type, status, dense) from ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    kind = F.get(F.array(F.lit("P-INT"), F.lit("P-EXT"), F.lit("P-CASE")), F.pmod("label", F.lit(3)))
    status = F.when(F.col("vec_id") % 11 == 0, "superseded").when(F.col("vec_id") % 13 == 0, "staging").otherwise("effective")
    return vectors.select(F.col("vec_id").alias("chunk_id"), kind.alias("corpus_type"), status.alias("status"), F.col("embedding").alias("dense"))

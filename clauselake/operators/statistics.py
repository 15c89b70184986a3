"""Statistics questions: a table of questions is read by expressions and answered by one plan for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

# Words that ask for totals, lists and sums, and that open a year's range.
TOTAL_WORDS = ("高发", "排名", "占比", "多少起", "多少件", "几起", "数量分布", "分布", "逐年", "统计", "最多", "总额", "汇总")
LIST_WORDS = ("有哪些", "列出", "列表")
SUM_WORDS = ("金额", "罚款", "罚没", "总额")
SINCE_WORDS = ("以来", "以后", "起", "至今")
# Words that name a dimension; the first dimension named counts, and categories if none is.
DIMENSION_WORDS = {
    "respondent_type": ("对象类型", "个人还是机构", "机构还是个人", "按对象"),
    "year": ("逐年", "年度", "按年", "每年", "哪一年"),
    "penalty_org": ("机构", "哪个局", "各局", "按机构"),
    "violation_category": ("板块", "事由", "违规类型", "违规事由"),
}
#: The key of a case along each dimension; a question never names a column.
KEYS = {"violation_category": "violation_category", "penalty_org": "penalty_org", "respondent_type": "respondent_type", "year": "CAST(year(penalty_date) AS STRING)"}


def read_questions(questions: DataFrame) -> DataFrame:
    """Adds what each question asks: ``listing``, ``dimension``, ``sums``, and the years ``low`` to ``high``.

    A four-digit year of this century bounds the answer from below if the question looks
    on from it, and from both sides if not; without one both bounds are null.
    """
    asks = F.trim(F.coalesce("question", F.lit("")))
    year = F.nullif(F.regexp_extract(asks, r"(20\d{2})\s*年", 1), F.lit("")).cast("int")
    named = F.coalesce(*[F.when(X.contains_any(asks, words), F.lit(name)) for name, words in DIMENSION_WORDS.items()], F.lit("violation_category"))
    return questions.withColumns({
        "listing": X.contains_any(asks, LIST_WORDS) & ~X.contains_any(asks, TOTAL_WORDS),
        "dimension": named,
        "sums": X.contains_any(asks, SUM_WORDS),
        "low": year,
        "high": F.when(~X.contains_any(asks, SINCE_WORDS), year),
    })


def countable(cases: DataFrame, versions: DataFrame) -> DataFrame:
    """Cases of indexed documents in force, with the document's title."""
    seen = versions.where("pipeline_status = 'INDEXED' AND version_status = 'effective'")
    return cases.join(seen.select("version_id", "title"), "version_id")


def _in_range(year: Column) -> Column:
    return (F.col("low").isNull() | (year >= F.col("low"))) & (F.col("high").isNull() | (year <= F.col("high")))


def totals(cases: DataFrame, versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key, n, amount, value) for questions that ask for totals; ``value`` is what was asked.

    Cases are summed by dimension, key and year before any question meets them, so the
    join is with a table that their number does not enlarge.
    """
    sides = F.array(*[F.struct(F.lit(name).alias("dimension"), F.expr(key).alias("key")) for name, key in KEYS.items()])
    cells = countable(cases, versions).select(F.inline(sides), F.year("penalty_date").alias("_year"), "amount_wan").groupBy("dimension", "key", "_year").agg(F.count("*").alias("n"), F.sum("amount_wan").alias("amount"))
    met = asked.where("NOT listing").join(cells, "dimension").where(_in_range(F.col("_year")))
    summed = met.groupBy("query_id", "sums", "key").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    return summed.select("query_id", "key", "n", "amount", F.when(F.col("sums"), F.col("amount")).otherwise(F.col("n").cast("double")).alias("value"))


def listings(cases: DataFrame, versions: DataFrame, asked: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` newest cases for questions that ask for a list, undated ones first; ties by id.

    Of each year only the newest can be listed, so these are kept before any question meets them.
    """
    order = (F.desc_nulls_first("penalty_date"), "version_id", "case_id")
    rows = countable(cases, versions).withColumn("_year", F.year("penalty_date"))
    newest = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_year").orderBy(*order))).where(F.col("_at") <= most)
    met = asked.where("listing").join(newest, _in_range(F.col("_year")))
    placed = met.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_at") <= most)
    return placed.select("query_id", "version_id", "title", "penalty_org", "penalty_date", "respondent_type", "penalty_type")


def labelled(found: DataFrame, label: str = "(未分类)") -> DataFrame:
    """Totals with a label for the null group, and whether the question has one."""
    return found.withColumns({"has_unlabelled": F.max(F.col("key").isNull()).over(Window.partitionBy("query_id")), "key": F.coalesce("key", F.lit(label))})

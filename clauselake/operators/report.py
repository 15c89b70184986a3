"""Batch reports and the verifiers: rates from events, reconciliation, idempotency, replay, smoke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

from .alignment import partial_ratio


def rate(part: Column, whole: Column) -> Column:
    """part / whole to 4 digits; null for nothing."""
    return F.round(F.try_divide(part, whole), 4)


def core_rates(events: DataFrame, docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many documents parsed, and passed quality at once, by ``by`` columns of ``docs`` and in all.

    ``events``: (version_id, to_state). The first row of each rate is the total, where the
    columns in ``by`` are null.
    """
    seen = events.groupBy("version_id").agg(*[F.max(F.col("to_state") == s).alias(s) for s in ("PARSING", "QC_PENDING", "STRUCTURING", "QC_FAILED")])
    joined = docs.join(seen, "version_id", "left").na.fill(False)
    grouped = joined.rollup(*by) if by else joined.groupBy()
    at_once = F.count_if(F.col("STRUCTURING") & ~F.col("QC_FAILED"))
    out = grouped.agg(F.count("*").alias("docs"), rate(F.count_if("QC_PENDING"), F.count_if("PARSING")).alias("parse_success_rate"), rate(at_once, F.count_if("QC_PENDING")).alias("qc_first_pass_rate"), *([F.grouping_id().alias("_level")] if by else []))
    return out.drop("_level")


def verify_rates(events: DataFrame) -> DataFrame:
    """Shares of the latest verify record per document; ``detail`` is JSON with a verify object."""
    verify = F.get_json_object("detail", "$.verify")
    flag = lambda k: F.get_json_object("_v", f"$.{k}").cast("boolean").cast("int")
    latest = events.withColumn("_v", verify).where("_v IS NOT NULL").groupBy("version_id").agg(F.max_by("_v", "id").alias("_v"))
    return latest.agg(F.round(F.avg(flag("t2_hit")), 4).alias("t2_pass_rate"), F.round(F.avg(flag("t4_pass")), 4).alias("t4_pass_rate"))


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def batch_statuses(docs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One map of status counts a batch."""
    counts = docs.groupBy(batch, "pipeline_status").agg(F.count("*").alias("n"))
    return counts.groupBy(batch).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pipeline_status", "n")))).alias("statuses"), F.sum("n").alias("docs"))


def obligation_coverage(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    duty = tags.where("tag_type = 'is_obligation'").select("chunk_id").distinct().withColumn("_d", F.lit(1))
    return chunks.where("NOT is_parent").join(duty, "chunk_id", "left").agg(F.count("_d").alias("obligation_chunks"), rate(F.count("_d"), F.count("*")).alias("coverage"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(version_id, expected, actual, matched) over versions that either side has."""
    count = lambda df, name: df.groupBy("version_id").agg(F.count("*").alias(name))
    both = count(expected, "expected").join(count(actual, "actual"), "version_id", "full_outer").na.fill(0)
    return both.withColumn("matched", F.col("expected") == F.col("actual"))


def differing_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (version_id, chunk_id, side) that one of two runs has and the other lacks; none if they agree."""
    a, b = first.select("version_id", "chunk_id"), second.select("version_id", "chunk_id")
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def replay(chunks: DataFrame, pages: DataFrame, window: int = 1, threshold: float = 92.0) -> DataFrame:
    """Whether each chunk's body stands on its pages, ``window`` pages around included.

    ``pages``: (version_id, page_no, text). Tables and degraded chunks are exempt. What is
    not found as it is, white space aside, is compared by partial ratio.
    """
    body = F.when((F.col("breadcrumb") != "") & F.col("text").startswith(F.col("breadcrumb")), F.substr("text", F.length("breadcrumb") + 1)).otherwise(F.col("text"))
    first = F.coalesce("page_start", F.lit(1))
    wanted = chunks.where("NOT is_parent").select("chunk_id", "version_id", (F.col("is_table") | F.col("degraded")).alias("exempt"), X.normalise(body).alias("_body"), (first - window).alias("_a"), (F.coalesce("page_end", first) + window).alias("_b"))
    near = wanted.select("chunk_id", "version_id", F.explode(F.sequence("_a", "_b")).alias("page_no")).join(pages.select("version_id", "page_no", X.normalise(F.col("text")).alias("_n")), ["version_id", "page_no"])
    texts = near.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_n"))), lambda p: p["_n"]), "").alias("_window"))
    joined = wanted.join(texts, "chunk_id", "left").na.fill({"_window": ""})
    exact = (F.col("_body") == "") | F.col("_window").contains(F.col("_body"))
    # The fuzzy comparison runs on what the exact one leaves.
    left = joined.withColumn("_exact", exact)
    sure = left.where("exempt OR _exact").select("chunk_id", "version_id", "exempt", F.lit(True).alias("matched"))
    fuzzy = left.where("NOT exempt AND NOT _exact").select("chunk_id", "version_id", "exempt", (partial_ratio(F.col("_body"), F.col("_window")) >= threshold).alias("matched"))
    return sure.unionByName(fuzzy)


def replay_summary(replayed: DataFrame) -> DataFrame:
    counted = ~F.col("exempt")
    return replayed.agg(F.count_if(counted).alias("total"), F.count_if(counted & F.col("matched")).alias("matched"), F.count_if(F.col("exempt")).alias("exempt"), F.try_divide(F.count_if(counted & F.col("matched")), F.count_if(counted)).alias("pass_rate"))


def smoke(hits: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(version_id, hit, rank): whether a document's own question finds it; query_id is its version."""
    found = hits.join(chunks.select("chunk_id", F.col("version_id").alias("_v")), "chunk_id").where("query_id = _v").groupBy(F.col("_v").alias("version_id")).agg(F.min("place").alias("rank"))
    return versions.select("version_id").join(found, "version_id", "left").select("version_id", F.col("rank").isNotNull().alias("hit"), "rank")


def synthetic_questions(chunks: DataFrame, versions: DataFrame, head: int = 30) -> DataFrame:
    """Each document's title and the head of its first chunk."""
    body = F.when((F.col("breadcrumb") != "") & F.col("text").startswith(F.col("breadcrumb")), F.substr("text", F.length("breadcrumb") + 1)).otherwise(F.col("text"))
    first = chunks.where("NOT is_parent").groupBy("version_id").agg(F.min_by(body, F.struct("seq", "chunk_id")).alias("_body"))
    return versions.join(first, "version_id", "left").select("version_id", F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.left(F.trim(F.regexp_replace(F.coalesce("_body", F.lit("")), r"^\s+", "")), F.lit(head)))).alias("question"))


def spread(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Least, median and greatest of a column."""
    return values.groupBy(*by).agg(F.min(column).alias("least"), F.median(column).alias("median"), F.max(column).alias("greatest"))


def fill_rates(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty values over all rows, a row per column (and group)."""
    fields = [c for c in rows.columns if c not in by]
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias("filled")) for c in fields])).alias("_f"))
    return long.groupBy(*by, F.col("_f.field").alias("field")).agg(F.count_if("_f.filled").alias("filled"), F.count("*").alias("total"), rate(F.count_if("_f.filled"), F.count("*")).alias("share"))


def failure_rates(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("key").agg(F.round(F.avg((~F.col("passed")).cast("int")), 4).alias("failure_rate"), F.count("*").alias("n")).orderBy(F.desc("failure_rate"), "key")


def threshold_advice(indicators: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """Per indicator: good documents that failed and bad ones that passed; advice from ``least`` on."""
    judged = indicators.join(labels, "version_id")
    good_failed, bad_passed = F.count_if(F.col("good") & ~F.col("passed")), F.count_if(~F.col("good") & F.col("passed"))
    return judged.groupBy("key").agg(F.min("value").alias("least"), F.median("value").alias("median"), F.max("value").alias("greatest"), F.count_if(~F.col("passed")).alias("fails"), good_failed.alias("good_failed"), bad_passed.alias("bad_passed"), F.when(good_failed >= least, "loosen").when(bad_passed >= least, "tighten").alias("advice"))


def latest_batch(batches: DataFrame) -> DataFrame:
    return batches.agg(F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("batch_id"), F.max("created_at").alias("created_at"))


def cumulative(docs: DataFrame) -> DataFrame:
    """Documents by state with the share of all, most first."""
    total = F.sum("n").over(Window.partitionBy())
    return docs.groupBy("pipeline_status").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 4))

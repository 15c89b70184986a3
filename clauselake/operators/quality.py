"""Quality indicators of parsed documents, and the gate they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

from .structure import clause_tree, question_groups


@dataclass(frozen=True)
class Thresholds:
    coverage_min: float = 0.95
    gaps_max: int = 0
    disorder_max: int = 0
    anchors_min: float = 1.0
    empty_tables_max: float = 0.05
    garbled_max: float = 0.01
    ocr_min: float = 0.85
    sufficiency_min: float = 0.7
    questions_min: float = 0.95
    edge: float = 0.02


# Indicators of question and case documents; all others have the seven of clauses.
CLAUSE_INDICATORS = ("clause_coverage", "clause_continuity", "hierarchy_legality", "page_anchor_complete", "table_consistency", "text_quality", "extraction_sufficiency")
PROFILES = {"P-QA": ("qa_pair_completeness", "page_anchor_complete", "text_quality"), "P-CASE": ("page_anchor_complete", "text_quality")}

_LOOSE = rf"^第[{X.NUMERAL}\dA-Za-z.]+条"


def _at_least(value: Column, threshold: float, edge: float | None) -> tuple[Column, Column]:
    passed = value >= threshold
    return passed, passed & (value <= threshold + edge) if edge is not None else F.lit(False)


def _at_most(value: Column, threshold: float, edge: float | None) -> tuple[Column, Column]:
    passed = value <= threshold
    return passed, passed & (value >= threshold - edge) if edge is not None else F.lit(False)


def indicator_values(blocks: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """One row a document with the value of every indicator, whatever its profile.

    ``blocks`` has version_id, idx, kind, text, page, page_end, ocr_conf and table_empty
    (true for a table without text in any cell). Garbled characters and blank pages are
    counted on text blocks. Documents without articles, tables or questions get the value
    that the indicator takes for nothing: 1, 0 and 0. ``tree``: the blocks' clause tree,
    where it is there already.
    """
    tree = clause_tree(blocks) if tree is None else tree
    article = F.col("level") == 3
    loose = X.normalise(F.col("text")).rlike(_LOOSE)
    is_text = F.col("kind") != "table"
    garbled = X.garbled_chars(F.col("text"))
    base = F.when(article, X.number_key(F.col("number"))[0])
    structural = Window.partitionBy("version_id", "_parent", "level").orderBy("idx")
    parents = tree.withColumn("_parent", F.regexp_replace("path", r"(^| > )[^>]*$", "")).withColumn("_before", F.lag(X.number_key(F.col("number"))).over(structural))
    disorder = F.col("level").isin(1, 2, 3) & F.col("_before").isNotNull() & (X.number_key(F.col("number")) <= F.col("_before"))
    basic = parents.groupBy("version_id").agg(
        F.count_if(article).alias("_articles"),
        F.count_if(loose).alias("_loose"),
        F.collect_set(base).alias("_bases"),
        F.count_if(disorder).alias("disorder"),
        F.count_if(is_text).alias("_texts"),
        F.count_if(is_text & F.col("page").isNotNull()).alias("_anchored"),
        F.count_if(~is_text).alias("_tables"),
        F.count_if(~is_text & F.col("table_empty")).alias("_empty"),
        F.sum(F.when(is_text, garbled["garbled"])).alias("_garbled"),
        F.sum(F.when(is_text, garbled["total"])).alias("_chars"),
        F.avg(F.when(is_text, F.col("ocr_conf"))).alias("ocr_mean"),
    )
    pages = blocks.where("page > 0").groupBy("version_id", "page").agg(F.sum(F.length(X.strip_ws(F.coalesce("text", F.lit(""))))).alias("n"))
    median = F.get(F.array_sort(F.collect_list("n")), F.floor(F.count("*") / 2).cast("int"))
    density = pages.groupBy("version_id").agg(F.least(F.lit(1.0), F.sum("n") / F.max("page") / F.greatest(F.lit(1), median)).alias("sufficiency"))
    questions = question_groups(blocks).groupBy("version_id").agg((F.count_if(F.col("answered")) / F.count("*")).alias("questions"))
    gaps = F.when(F.size("_bases") > 0, F.size(F.array_except(F.sequence(F.array_min("_bases"), F.array_max("_bases")), F.col("_bases")))).otherwise(0)
    share = lambda part, whole, none: F.coalesce(F.try_divide(part, whole), F.lit(none))
    return basic.join(density, "version_id", "left").join(questions, "version_id", "left").select(
        "version_id",
        share(F.col("_articles"), F.col("_loose"), 1.0).alias("coverage"),
        gaps.cast("double").alias("gaps"),
        F.col("disorder").cast("double").alias("disorder"),
        share(F.col("_anchored"), F.col("_texts"), 1.0).alias("anchors"),
        share(F.col("_empty"), F.col("_tables"), 0.0).alias("empty_tables"),
        share(F.col("_garbled"), F.col("_chars"), 0.0).alias("garbled"),
        "ocr_mean",
        F.coalesce("sufficiency", F.lit(0.0)).alias("sufficiency"),
        F.coalesce("questions", F.lit(0.0)).alias("questions"),
    )


def indicators(values: DataFrame, profiles: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """A row per document and indicator of its profile: value, threshold, passed, marginal.

    ``profiles``: (version_id, corpus_type). A value within ``edge`` of its threshold on the
    passing side is marginal, where the threshold leaves room for that.
    """
    t = limits or Thresholds()
    c = F.col

    def row(key: str, value: str, threshold: float, verdict: tuple[Column, Column]) -> Column:
        return F.struct(F.lit(key).alias("key"), c(value).cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"), verdict[0].alias("passed"), verdict[1].alias("marginal"))

    clean = _at_most(c("garbled"), t.garbled_max, None)
    every = (
        row("clause_coverage", "coverage", t.coverage_min, _at_least(c("coverage"), t.coverage_min, t.edge)),
        row("clause_continuity", "gaps", t.gaps_max, _at_most(c("gaps"), t.gaps_max, None)),
        row("hierarchy_legality", "disorder", t.disorder_max, _at_most(c("disorder"), t.disorder_max, None)),
        row("page_anchor_complete", "anchors", t.anchors_min, _at_least(c("anchors"), t.anchors_min, None)),
        row("table_consistency", "empty_tables", t.empty_tables_max, _at_most(c("empty_tables"), t.empty_tables_max, t.edge)),
        row("text_quality", "garbled", t.garbled_max, (clean[0] & F.coalesce(c("ocr_mean") >= t.ocr_min, F.lit(True)), clean[1])),
        row("extraction_sufficiency", "sufficiency", t.sufficiency_min, _at_least(c("sufficiency"), t.sufficiency_min, t.edge)),
        row("qa_pair_completeness", "questions", t.questions_min, _at_least(c("questions"), t.questions_min, t.edge)),
    )
    wanted = F.array(*map(F.lit, CLAUSE_INDICATORS))
    for profile, keys in PROFILES.items():
        wanted = F.when(c("corpus_type") == profile, F.array(*map(F.lit, keys))).otherwise(wanted)
    listed = values.join(profiles, "version_id", "left").withColumn("_wanted", wanted)
    return listed.select("version_id", "corpus_type", F.inline(F.filter(F.array(*every), lambda r: F.array_contains("_wanted", r["key"]))))


def gate(rows: DataFrame) -> DataFrame:
    """One row a document: passed, marginal, the failed keys and all evidence as JSON."""
    ordered = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("key"))))
    evidence = F.to_json(F.array_sort(F.collect_list(F.struct("key", "value", "threshold", "passed"))))
    return rows.groupBy("version_id").agg(F.min("passed").alias("passed"), F.max("marginal").alias("marginal"), ordered(~F.col("passed")).alias("failed"), ordered(F.col("marginal")).alias("marginal_keys"), evidence.alias("evidence"))


def next_states(verdicts: DataFrame) -> DataFrame:
    """What the gate makes of documents: STRUCTURING, or QC_FAILED with a queue item's type."""
    return verdicts.select("version_id", F.when(F.col("passed"), "STRUCTURING").otherwise("QC_FAILED").alias("to_state"), F.when(~F.col("passed"), "E301").alias("error_code"), F.when(~F.col("passed"), "qc_fix").alias("queue_type"), F.col("marginal").alias("qc_marginal"), F.col("evidence").alias("detail"))

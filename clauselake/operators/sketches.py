"""Spreads and thresholds from sketches that are kept for each batch and merged.

A batch is read once, when it is new. What is kept of it, for each group, is a row of a few
kilobytes: counts, least and greatest value, a quantile sketch and a sketch of distinct
keys. A report over any set of batches merges their rows. ``report.spread`` and
``report.threshold_advice`` are the exact forms over all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketches; ranks are off by less than 0.5 % with it.
K = 800
#: log2 of the number of buckets of the sketches of distinct keys; 1.6 % of error.
LOG_BUCKETS = 12


def of_batches(values: DataFrame, column: str, key: str, *by: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group of ``by``, the batch among it: n, least, greatest, sketch, keys, and a count of each of ``flags``.

    Null values and NaN are left out, their flags too. A group without values has no row.
    """
    rows = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    value = F.col(column).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.kll_sketch_agg_double(value, K).alias("sketch"),
        F.hll_sketch_agg(F.col(key).cast("string"), LOG_BUCKETS).alias("keys"),
        *[F.count_if(flag).alias(name) for name, flag in (flags or {}).items()],
    )


def merged(sketches: DataFrame, *by: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``of_batches`` summed up over all batches, in the same columns."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.hll_union_agg("keys").alias("keys"),
        *[F.sum(name).alias(name) for name in flags],
    )


def quantile(sketch: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def spread(sketches: DataFrame, *by: str) -> DataFrame:
    """Least, median and greatest value, n and about how many distinct keys, over all batches."""
    found = merged(sketches, *by)
    return found.select(*by, "n", "least", quantile("sketch", 0.5).alias("median"), "greatest", F.hll_sketch_estimate("keys").alias("distinct_keys"))


def threshold_flags(good: Column, passed: Column) -> dict[str, Column]:
    """What ``threshold_advice`` needs to have been counted."""
    return {"fails": ~passed, "good_failed": good & ~passed, "bad_passed": ~good & passed}


def threshold_advice(sketches: DataFrame, key: str = "key", least: int = 2) -> DataFrame:
    """Per indicator: its spread, good documents that failed and bad ones that passed; advice from ``least`` on."""
    found = merged(sketches, key, flags=("fails", "good_failed", "bad_passed"))
    advice = F.when(F.col("good_failed") >= least, "loosen").when(F.col("bad_passed") >= least, "tighten")
    return found.select(key, "least", quantile("sketch", 0.5).alias("median"), "greatest", "fails", "good_failed", "bad_passed", advice.alias("advice"))

"""Spreads from merged sketches against the exact ones."""

import random

from pyspark.sql import functions as F

from clauselake.operators import report, sketches


def test_merged_batches_are_near_the_exact_spread(spark):
    draw = random.Random(3)
    rows = [(k % 3, k % 20, k % 5000, draw.lognormvariate(0, 2)) for k in range(30_000)]
    frame = spark.createDataFrame(rows, "kind int, batch int, doc int, v double")
    kept = sketches.of_batches(frame, "v", "doc", "kind", "batch")
    assert kept.count() == 60
    found = {r.kind: r for r in sketches.spread(kept, "kind").collect()}
    exact = {r.kind: r for r in report.spread(frame, "v", "kind").collect()}
    for kind, r in found.items():
        own = sorted(v for k, _, _, v in rows if k == kind)
        assert (r.n, r.least, r.greatest) == (len(own), exact[kind].least, exact[kind].greatest)
        assert abs(r.distinct_keys - 5000) < 400
        for share in (0.05, 0.5, 0.99):
            at = sketches.merged(kept.where(F.col("kind") == kind), "kind").select(sketches.quantile("sketch", share).alias("q")).first().q
            assert abs(sum(v <= at for v in own) / len(own) - share) < 0.01


def test_a_batch_is_added_and_nulls_are_left_out(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, batch int, doc int, value double, good boolean")
    first, later = frame([("a", 1, 1, 1.0, True), ("a", 1, 2, None, True), ("a", 1, 3, float("nan"), True), ("b", 1, 1, None, False)]), frame([("a", 2, 4, 3.0, True), ("a", 2, 5, 9.0, False)])
    flags = sketches.threshold_flags(F.col("good"), F.col("value") >= 5)
    kept = sketches.of_batches(first, "value", "doc", "key", "batch", flags=flags).unionByName(sketches.of_batches(later, "value", "doc", "key", "batch", flags=flags))
    (row,) = sketches.threshold_advice(kept).collect()
    assert tuple(row) == ("a", 1.0, 3.0, 9.0, 2, 2, 1, "loosen")
    assert sketches.threshold_advice(kept.limit(0)).count() == 0

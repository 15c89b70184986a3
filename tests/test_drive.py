"""The batch drive as a stream that is stopped and resumed."""

import pytest

from clauselake.streaming import drive, events

STATES = ("REGISTERED", "PARSING", "QC_PENDING", "STRUCTURING", "META_REVIEW", "INDEXED")


def write_log(spark, path, ids):
    rows = spark.createDataFrame([(k, k * 7 % 11, STATES[k * k % 13 % 6], None) for k in ids], "id long, version_id long, to_state string, error_code string")
    rows.selectExpr("*", "timestamp_seconds(id) AS at").coalesce(1).write.mode("append").parquet(path)
    return rows


def test_stops_and_resumes_without_doubling(spark, tmp_path):
    source, steps, checkpoint = (str(tmp_path / n) for n in ("in", "steps", "checkpoint"))
    log = [write_log(spark, source, range(k * 50, k * 50 + 50)) for k in range(4)]
    written = drive.once(steps)

    def breaks(batch, batch_id):
        written(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("the driver is lost behind the write of batch 1")

    with pytest.raises(Exception, match="batch 1"):
        drive.drive(spark, source, steps, checkpoint, files_per_batch=1, put=breaks).awaitTermination()
    half = drive.steps_of(spark, steps)
    assert half.count() == 100
    drive.drive(spark, source, steps, checkpoint, files_per_batch=1).awaitTermination()
    whole = log[0].union(log[1]).union(log[2]).union(log[3])
    want = sorted(map(tuple, events.lifecycle_table(whole).collect()), key=str)
    assert sorted(map(tuple, drive.steps_of(spark, steps).select("version_id", "id", "from_state", "to_state", "legal").collect()), key=str) == want
    # Another start finds nothing new; a file that comes later is taken up with the state kept.
    drive.drive(spark, source, steps, checkpoint, files_per_batch=1).awaitTermination()
    assert drive.steps_of(spark, steps).count() == 200
    later = write_log(spark, source, range(200, 230))
    drive.drive(spark, source, steps, checkpoint).awaitTermination()
    want = sorted(map(tuple, events.lifecycle_table(whole.union(later)).collect()), key=str)
    got = drive.steps_of(spark, steps)
    assert sorted(map(tuple, got.select("version_id", "id", "from_state", "to_state", "legal").collect()), key=str) == want
    last = {v: s for v, i, _, s, legal in sorted(want, key=lambda r: r[1]) if legal}
    assert {r.version_id: r.pipeline_status for r in drive.current_states(got).collect()} == last

"""A batch driven as a stream: events are taken up as files arrive, and a stopped run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import events

STEPS = "version_id long, id long, from_state string, to_state string, legal boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: every micro-batch is a folder of its own, named by the batch's id.

    A batch that is run again after a failure replaces what its first run has written, so
    each step is there once, however often a run is stopped.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State is kept in RocksDB while the query is started; the session's own choice comes back after it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drive(spark: SparkSession, source: str, steps: str, checkpoint: str, *, files_per_batch: int = 100, put: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the run over all event files that are there, and ends behind the last one.

    ``source`` holds Parquet files of events, in the order of their arrival. Each document
    keeps its state between micro-batches; a step that is no edge is written as refused
    and changes nothing. Steps go to ``steps`` by ``once``. Within a micro-batch, a
    document's events are taken by id; ``files_per_batch`` bounds what it holds. Started
    again with the same ``checkpoint``, the run takes up the files that are new.
    """
    with _rocks(spark):
        stream = events.lifecycle(events.read(spark, source, files_per_batch))
        return stream.writeStream.foreachBatch(put or once(steps)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def steps_of(spark: SparkSession, steps: str) -> DataFrame:
    """All steps that the runs have written."""
    return spark.read.schema(f"{STEPS}, batch long").option("basePath", steps).parquet(steps).drop("batch")


def current_states(steps: DataFrame) -> DataFrame:
    """(version_id, pipeline_status, last_id): where the legal steps have led each document."""
    return steps.where("legal").groupBy("version_id").agg(F.max_by("to_state", "id").alias("pipeline_status"), F.max("id").alias("last_id"))

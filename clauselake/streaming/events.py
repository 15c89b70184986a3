"""The event log as a stream: windowed counts with a watermark, and each document's state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from clauselake.operators.registry import RESET_FROM, TRANSITIONS

SCHEMA = "id long, version_id long, to_state string, error_code string, at timestamp"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events from Parquet files as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events by window and state; rows later than ``late`` behind the newest are dropped.

    Works on a stream (append mode) and on a table alike.
    """
    span = F.window("at", window, slide) if slide else F.window("at", window)
    return events.withWatermark("at", late).groupBy(span.alias("w"), "to_state").agg(F.count("*").alias("n"), F.approx_count_distinct("version_id").alias("documents")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "to_state", "n", "documents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a document's events with no pause above ``gap``."""
    return events.withWatermark("at", late).groupBy("version_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("version_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def _legal(now: str | None, to_state: str) -> bool:
    return to_state in TRANSITIONS.get(now, ()) or (to_state == "REGISTERED" and (now is None or now in RESET_FROM))


class _Lifecycle(StatefulProcessor):
    """Keeps a document's state and reports each step as taken or refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", StructType([StructField("state", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self._state.get()[0] if self._state.exists() else None
        for row in sorted(rows, key=lambda r: r.id):
            legal = _legal(now, row.to_state)
            yield Row(version_id=key[0], id=row.id, from_state=now, to_state=row.to_state, legal=legal)
            now = row.to_state if legal else now
        if now is not None:
            self._state.update((now,))

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether the step was legal; refused steps change nothing."""
    return events.groupBy("version_id").transformWithState(_Lifecycle(), "version_id long, id long, from_state string, to_state string, legal boolean", "Append", "None")


#: Steps that are legal, as ``from>to``; nothing comes before the > of a first step.
LEGAL = sorted({f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets} | {f"{a}>REGISTERED" for a in ("", *RESET_FROM)})


def _step(now: Column, to_state: Column) -> Column:
    """Whether the step is legal."""
    return F.array_contains(F.array(*map(F.lit, LEGAL)), F.concat(F.coalesce(now, F.lit("")), F.lit(">"), F.coalesce(to_state, F.lit("?"))))


def lifecycle_table(events: DataFrame, piece: int = 256) -> DataFrame:
    """The same over a finished table, without gathering a document's events.

    A document's events are cut into pieces of ``piece`` in the order of ids. Each piece of
    a document with several is reduced to the states it leads to, one from every state;
    these, one row a piece, give each piece its first state, and pieces are then replayed.
    """
    none = F.lit(None).cast("string")
    order = F.row_number().over(Window.partitionBy("version_id").orderBy("id")) - 1
    placed = events.select("version_id", "id", "to_state", F.floor(order / piece).alias("_piece"))
    pieces = placed.groupBy("version_id", "_piece").agg(F.array_sort(F.collect_list(F.struct("id", "to_state"))).alias("_rows"))
    after = lambda start: F.aggregate("_rows", start, lambda now, e: F.when(_step(now, e["to_state"]), e["to_state"]).otherwise(now))
    names = ["", *sorted(TRANSITIONS)]
    ends = F.transform(F.array(none, *map(F.lit, names[1:])), after)
    maps = pieces.where(F.size("_rows") == piece).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("_piece", ends.alias("_ends")))).alias("_maps"))

    def lead(acc: Column, m: Column) -> Column:
        return F.array_append(acc, F.element_at(m["_ends"], F.array_position(F.array(*map(F.lit, names)), F.coalesce(F.element_at(acc, -1), F.lit(""))).cast("int")))

    starts = maps.select("version_id", F.posexplode(F.aggregate("_maps", F.array(none), lead)).alias("_at", "_start"))
    begun = pieces.join(starts.withColumnRenamed("_at", "_piece"), ["version_id", "_piece"], "left")
    empty = F.struct(F.col("_start").alias("now"), F.array().cast("array<struct<id:bigint,from_state:string,to_state:string,legal:boolean>>").alias("steps"))

    def walk(acc: Column, e: Column) -> Column:
        legal = _step(acc["now"], e["to_state"])
        step = F.struct(e["id"].cast("long").alias("id"), acc["now"].alias("from_state"), e["to_state"].alias("to_state"), legal.alias("legal"))
        return F.struct(F.when(legal, e["to_state"]).otherwise(acc["now"]).alias("now"), F.array_append(acc["steps"], step).alias("steps"))

    return begun.select("version_id", F.inline(F.aggregate("_rows", empty, walk)["steps"]))

"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Document rates solve  min sum r (log r - 1)  subject to  sum_{d in s} r_d size_d = target_s,
0 <= r <= cap.  The dual separates into one convex problem per source, and its
solution is an exponential tilt  r_d = min(cap, exp(lambda_s * x_d))  with x_d the
size over the source's mean size.  Rates depend on (source, size) alone, so Newton
runs on a histogram of these cells, one distributed aggregation a step.  Rates are
then rounded into whole copies so that a source's tokens meet its target.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
_SOURCE = ("_absent", "_source")


def source_targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``target`` to rows (_absent, _source, source_size).

    Sources in code-point order (null last) weigh ``weights`` in turn and share the
    total size. A target above ``cap`` times its source's size stops there and the
    excess is shared again by weight. With sources in the order of cap over weight,
    the common level is the maximum of (total - caps before) / (weights from here on),
    so running sums replace the rounds of resharing. One row a source meets in one task.
    """
    order = Window.orderBy("_absent", "_source")
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_absent", "_source").rowsBetween(Window.unboundedPreceding, -1)
    weighed = sources.select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * F.lit(float(cap))).alias("_cap"),
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    return weighed.withColumn("_level", level).withColumn("target", F.least(F.col("_cap"), F.col("_weight") * F.max("_level").over(everything))).drop("_level", "_cap", "_weight")


def _rate(cap: float, tilt: Column, x: Column) -> Column:
    return F.least(F.lit(float(cap)), F.exp(tilt * x))


def newton_tilts(cells: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """Solves each source's dual: rows (_absent, _source, ..., tilt).

    Newton on log(tokens) - log(target), kept within a bracket that each step narrows;
    a step that would leave the bracket halves it instead, and from the 20th step on so
    does every third, so the search ends: at the tolerance, or where the bracket holds no other number.
    Each step aggregates the cells; the driver sees only whether any source is open.
    Sources at their cap, or without words, need no search.
    """
    state = cut(
        sources.withColumns({
            "tilt": F.lit(0.0),
            "_low": F.lit(-1e4),
            "_high": F.lit(1e4),
            "_open": (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-9)),
        })
    )
    for turn in itertools.count():
        x = F.try_divide(F.col("_size") * F.col("source_docs"), F.col("source_size"))
        rate = F.exp(F.col("tilt") * x)
        sums = (
            cells.join(state.where("_open"), list(_SOURCE))
            .groupBy(*_SOURCE)
            .agg(F.sum(F.col("_docs") * F.col("_size") * F.least(F.lit(float(cap)), rate)).alias("_tokens"), F.sum(F.when(rate < cap, F.col("_docs") * F.col("_size") * x * rate).otherwise(0.0)).alias("_slope"))
        )
        high = F.col("_tokens") > F.col("target")
        low_, high_ = F.when(high, F.col("_low")).otherwise(F.col("tilt")), F.when(high, F.col("tilt")).otherwise(F.col("_high"))
        step = F.col("tilt") - F.log(F.try_divide("_tokens", "target")) * F.try_divide("_tokens", "_slope")
        state = cut(
            state.join(sums, list(_SOURCE), "left")
            .withColumns({"_error": F.when(F.col("_open"), F.abs(F.try_divide("_tokens", "target") - 1)).otherwise(0.0)})
            .withColumns({"_new_low": low_, "_new_high": high_, "_step": step})
            .withColumns({
                "_open": F.col("_open") & (F.col("_error") > tolerance) & (F.col("_new_high") - F.col("_new_low") > F.lit(1e-14) * F.greatest(F.lit(1.0), F.abs("tilt"))),
            })
            .select(
                *[c for c in state.columns if c not in ("tilt", "_low", "_high", "_open")],
                F.when(~F.col("_open"), F.col("tilt")).when(F.lit(turn < 20 or turn % 3 < 2) & (F.col("_step") > F.col("_new_low")) & (F.col("_step") < F.col("_new_high")), F.col("_step")).otherwise((F.col("_new_low") + F.col("_new_high")) / 2).alias("tilt"),
                F.when(F.col("_open"), F.col("_new_low")).otherwise(F.col("_low")).alias("_low"),
                F.when(F.col("_open"), F.col("_new_high")).otherwise(F.col("_high")).alias("_high"),
                "_open",
            )
        )
        if not state.where("_open").limit(1).count():
            break
    return state.drop("_low", "_high", "_open")


def round_cells(cells: DataFrame, tilts: DataFrame, cap: int) -> DataFrame:
    """Whole copies for each cell: rows (_absent, _source, _size, _docs, _copies).

    Cells are rounded on the running sum of their expected copies, largest size
    first, so that rounding errors cancel along a source. What a source still lacks
    or has too much is then corrected from the largest size that fits down to the
    smallest. A source's cells meet in one row: one cell for each distinct size, which
    the longest document bounds, however many documents there are.
    """
    x = F.try_divide(F.col("_size") * F.col("source_docs"), F.col("source_size"))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)
    rate = F.when(F.col("_size") == 0, F.lit(1.0)).when(full, F.lit(float(cap))).otherwise(_rate(cap, F.col("tilt"), x))
    down = Window.partitionBy(*_SOURCE).orderBy(F.col("_size").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    rounded = (
        cells.join(tilts, list(_SOURCE))
        .withColumn("_rate", rate)
        .withColumn("_sum", F.round(F.sum(F.col("_docs") * (F.col("_rate") - F.floor("_rate"))).over(upto)).cast("long"))
        .withColumn("_copies", F.floor("_rate") * F.col("_docs") + F.col("_sum") - F.coalesce(F.lag("_sum").over(down), F.lit(0)))
        .withColumn("_copies", F.greatest(F.lit(0), F.least(F.col("_copies"), F.col("_docs") * cap)).cast("long"))
        .select(*_SOURCE, "_size", "_docs", "_copies", "source_size", "target")
    )
    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("fixes"))

    def fix(acc: Column, cell: Column) -> Column:
        wanted = acc["left"] / cell["_size"]
        whole = F.when(wanted < 0, F.ceil(wanted)).otherwise(F.floor(wanted)).cast("long")
        more = F.greatest(-cell["_copies"], F.least(cell["_docs"] * cap - cell["_copies"], whole))
        return F.struct(
            (acc["left"] - more * cell["_size"]).cast("double").alias("left"),
            F.when(more == 0, acc["fixes"]).otherwise(F.concat(acc["fixes"], F.array(F.struct(cell["_size"].alias("size"), more.cast("bigint").alias("more"))))).alias("fixes"),
        )

    fixes = (
        rounded.where("_size > 0")
        .groupBy(*_SOURCE)
        .agg(F.sort_array(F.collect_list(F.struct("_size", "_docs", "_copies")), asc=False).alias("_cells"), (F.first("target") - F.sum(F.col("_size") * F.col("_copies"))).cast("double").alias("_left"))
        .select(*_SOURCE, F.explode(F.aggregate("_cells", start, fix)["fixes"]).alias("_fix"))
        .select(*_SOURCE, F.col("_fix.size").alias("_size"), F.col("_fix.more").alias("_more"))
    )
    return rounded.join(fixes, [*_SOURCE, "_size"], "left").withColumn("_copies", F.col("_copies") + F.coalesce("_more", F.lit(0))).drop("_more")


def mix_to_targets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    salts: int = 256,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How often each document goes into the mix.

    Returns one row per input row: doc_id, source, size (words; null text 0),
    source_size, target, copies (0 to ``cap``), taken (copies times size) and the
    input columns named in ``carry``, under their own names, in a struct ``carried``.
    Columns of other names are ignored, whatever they are called.

    Null source is a source of its own, last in order. A null id is allowed. Documents
    without words get one copy, as they cost nothing. Rows with the same id, source
    and text are interchangeable; everything else is ordered by id and text hash, so
    reruns agree. An empty table gives an empty result. Cells are split by ``salts``
    hash values of the id, and no task gathers a hot source or a hot size whole.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().cast("int").alias("_absent"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(text).alias("_tie"),
        F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text)), F.lit(salts)).alias("_salt"),
        *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []),
    )
    sized = sized if carry else cut(sized)
    salted = cut(sized.groupBy(*_SOURCE, "_size", "_salt").agg(F.count("*").alias("_salt_docs")))
    cells = cut(salted.groupBy(*_SOURCE, "_size").agg(F.sum("_salt_docs").alias("_docs")))
    sources = source_targets(cells.groupBy(*_SOURCE).agg(F.sum(F.col("_size") * F.col("_docs")).alias("source_size"), F.sum("_docs").alias("source_docs")), weights, cap)
    copies = round_cells(cells, newton_tilts(cells, sources, cap), cap)
    in_cell = Window.partitionBy(*_SOURCE, "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    slots = cut(salted.withColumn("_before", F.coalesce(F.sum("_salt_docs").over(in_cell), F.lit(0))).join(copies, [*_SOURCE, "_size"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*_SOURCE, "_size", "_salt").orderBy("doc_id", "_tie")) - 1
    return (
        sized.join(slots, [*_SOURCE, "_size", "_salt"])
        .withColumn("copies", (F.floor(F.col("_copies") / F.col("_docs")) + (rank < F.col("_copies") % F.col("_docs")).cast("long")).cast("long"))
        .select(
            "doc_id",
            F.when(F.col("_absent") == 0, F.col("_source")).alias("source"),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("_size")).alias("taken"),
            *(["carried"] if carry else []),
        )
    )

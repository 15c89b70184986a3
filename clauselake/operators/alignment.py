"""Placing blocks on pages: anchors, their longest chain, what stands between, and edits for the rest."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from clauselake.functions import text as X


def _best_window(needle: str, text: str) -> tuple[float, int]:
    """(ratio in percent, start) of the stretch of ``text`` most like ``needle``."""
    if not needle or not text:
        return (100.0 if not needle else 0.0), 0
    matcher = SequenceMatcher(None, needle, text, autojunk=False)
    best, at = 0.0, 0
    for block in matcher.get_matching_blocks():
        start = max(0, min(block.b - block.a, len(text) - 1))
        ratio = SequenceMatcher(None, needle, text[start : start + len(needle)], autojunk=False).ratio() * 100
        if ratio > best:
            best, at = ratio, start
    return best, at


@F.pandas_udf(DoubleType())
def partial_ratio(needles: pd.Series, texts: pd.Series) -> pd.Series:
    """How like the needle the best stretch of the text is, in percent."""
    return pd.Series([_best_window(a or "", b or "")[0] for a, b in zip(needles, texts, strict=True)])


def page_offsets(pages: DataFrame) -> DataFrame:
    """(version_id, page_no, start, end) of each page in the document's normalised text."""
    return _offsets(pages.select("version_id", "page_no", X.normalise(F.col("text")).alias("n")))


def _offsets(pages: DataFrame) -> DataFrame:
    upto = Window.partitionBy("version_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("n")
    return pages.select("version_id", "page_no", (F.sum(n).over(upto) - n).alias("start"), F.sum(n).over(upto).alias("end"))


#: Characters of a gram, and the share of grams that are anchors, chosen by their hash.
GRAM, ONE_IN = 12, 8
#: Characters by which a block may lie off the place that the blocks before it leave for it, beside an eighth of what was not found.
OFF = 64


def _anchors(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the grams whose hash says so and that occur once; none crosses one of ``ends``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(h % np.uint64(ONE_IN) == 0)
    at = at[at + GRAM <= ends[np.searchsorted(ends, at, "right")]] if len(at) else at
    told, first, count = np.unique(h[at], return_index=True, return_counts=True)
    return told[count == 1], at[first[count == 1]]


def _chain(starts: list[int]) -> list[int]:
    """Which of ``starts`` make the longest run of rising ones."""
    tails, at, before = [], [], [-1] * len(starts)
    for k, start in enumerate(starts):
        place = bisect_left(tails, start)
        before[k] = at[place - 1] if place else -1
        tails[place : place + 1], at[place : place + 1] = [start], [k]
    rows, k = [], at[-1] if at else -1
    while k >= 0:
        rows.append(k)
        k = before[k]
    return rows[::-1]


class Span(NamedTuple):
    """Where a needle stands: ``start`` to ``stop``, of which ``sure`` to ``upto`` is told by what both have alike."""

    start: int
    sure: int
    upto: int
    stop: int


def _exact(start: int, needle: str) -> Span:
    return Span(start, start, start + len(needle), start + len(needle))


def _anchored(needles: list[str], text: str) -> list[Span | None]:
    """The span of each needle that anchors place in ``text``, None for the others.

    A needle that was changed starts by its first anchor and stops by its last one; the
    characters before and behind these may be more or fewer than its own, so its
    neighbours are kept off only what the anchors span.
    """
    spans: list[Span | None] = [None] * len(needles)
    ends = np.cumsum([len(n) for n in needles])
    (own, at), (theirs, there) = _anchors("".join(needles), ends), _anchors(text, np.array([len(text)]))
    _, i, j = np.intersect1d(own, theirs, assume_unique=True, return_indices=True)
    order = np.argsort(at[i])
    at, there = at[i][order], there[j][order]
    which = np.searchsorted(ends, at, "right")
    told = there - (at - np.append(0, ends)[which])
    votes: dict[int, dict[int, int]] = {}
    for k, start in zip(which.tolist(), told.tolist(), strict=True):
        own_votes = votes.setdefault(k, {})
        own_votes[start] = own_votes.get(start, 0) + 1
    best = [(k, max(v, key=lambda x: (v[x], -x))) for k, v in sorted(votes.items())]
    best = [(k, start) for k, start in best if start >= 0]
    for n in _chain([start for _, start in best]):
        k, start = best[n]
        if text.startswith(needles[k], start):
            spans[k] = _exact(start, needles[k])
        else:
            own_anchors = slice(*np.searchsorted(which, [k, k + 1]))
            close = np.abs(told[own_anchors] - start) <= OFF
            starts, places = told[own_anchors][close].tolist(), there[own_anchors][close]
            sure, upto = int(places.min()), int(places.max()) + GRAM
            spans[k] = Span(max(0, min(starts[0], sure)), sure, upto, min(len(text), max(starts[-1] + len(needles[k]), upto)))
    return spans


def _bounds(spans: list[Span | None]) -> tuple[list[int], list[int], list[int | None]]:
    """For each needle where those placed before it surely end, where they stop, and where the next one placed surely begins."""
    low, behind, high, upto, stop = [], [], [], 0, 0
    for span in spans:
        low.append(upto)
        behind.append(stop)
        if span:
            upto, stop = max(upto, span.upto), max(stop, span.stop)
    after = None
    for span in reversed(spans):
        high.append(after)
        if span:
            after = span.sure if after is None else min(span.sure, after)
    return low, behind, high[::-1]


def _between(needles: list[str], text: str, spans: list[Span | None], near: bool) -> list[Span | None]:
    """``spans`` with the needles that stand between the placed ones as they are, each behind the one before.

    With ``near`` a needle counts only about where those before it leave off, and nearest
    to that, so that one that was changed is not taken for its copy further on, past all
    that follows it.
    """
    low, behind, high = _bounds(spans)
    found, at, expected = list(spans), 0, 0
    for k, n in enumerate(needles):
        if spans[k] or not n:
            continue
        if k == 0 or spans[k - 1] or low[k] > at:
            at, expected = max(at, low[k]), max(at, behind[k])
        end = len(text) if high[k] is None else high[k]
        if near:
            off = OFF + (expected - at) // 8
            after = text.find(n, expected, min(end, expected + off + len(n)))
            before = -1 if after == expected else text.rfind(n, max(at, expected - off), min(end, expected + len(n) - 1))
            place = before if before >= 0 and (after < 0 or expected - before <= after - expected) else after
        else:
            place = text.find(n, at, end)
        if place >= 0:
            found[k], at, expected = _exact(place, n), place + len(n), place + len(n)
        else:
            expected += len(n)
    return found


_PLACE = StructType([StructField("idx", IntegerType()), StructField("n", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("low", IntegerType()), StructField("window", StringType())])


@F.arrow_udf(ArrayType(_PLACE))
def _placed(blocks: pa.Array, texts: pa.Array) -> pa.Array:
    """Each block of a document with its span in the document's text, or else the text in which it may stand changed."""
    names, rows = ("idx", "n", "start", "stop", "low", "window"), []
    for own, text in zip(blocks.to_pylist(), texts.to_pylist(), strict=True):
        needles = [b["n"] for b in own]
        spans = _between(needles, text, _between(needles, text, _anchored(needles, text), True), False)
        low, _, high = _bounds(spans)
        rows.append([])
        for b, span, a, z in zip(own, spans, low, high, strict=True):
            if b["n"] and span:
                # A changed block keeps off those placed ahead of it and behind it.
                rows[-1].append((b["idx"], b["n"], min(max(span.start, a), span.sure), max(span.stop if z is None else min(span.stop, z), span.upto), a, None))
            elif b["n"]:
                reach = min(len(text) if z is None else max(0, z - a), max(4 * len(b["n"]), 500))
                rows[-1].append((b["idx"], b["n"], None, None, a, text[a : a + reach]))
    return pa.array([[dict(zip(names, r, strict=True)) for r in own] for own in rows], pa.list_(pa.struct([("idx", pa.int32()), ("n", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("low", pa.int32()), ("window", pa.string())])))


def _nearest_end(needle: str, text: str) -> tuple[int, int]:
    """(edits, end): the end of the stretch of ``text`` with the fewest edits from ``needle``, by columns of bits."""
    n = len(needle)
    where: dict[str, int] = {}
    for k, c in enumerate(needle):
        where[c] = where.get(c, 0) | 1 << k
    ones, top = (1 << n) - 1, 1 << n - 1
    up, down, edits, best, at = ones, 0, n, n, 0
    for k, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(xh | up) & ones, up & xh
        edits += (more & top != 0) - (less & top != 0)
        more, less = more << 1 & ones, less << 1 & ones
        up, down = less | ~(xv | more) & ones, more & xv
        if edits < best:
            best, at = edits, k + 1
    return best, at


@F.arrow_udf(StructType([StructField("edits", IntegerType()), StructField("end", IntegerType())]))
def _nearest(needles: pa.Array, texts: pa.Array) -> pa.Array:
    found = [_nearest_end(a, b) if a and b else (len(a or ""), 0) for a, b in zip(needles.to_pylist(), texts.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([e for e, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], names=["edits", "end"])


def _located(blocks: DataFrame, pages: DataFrame, threshold: float) -> DataFrame:
    """(version_id, idx, start, stop, _pages) of the blocks (version_id, idx, n) in the text of their pages (version_id, page_no, n).

    Texts are dealt by document once; what follows goes on within its row. ``_pages``: the
    end and number of each page of the document.
    """
    own = blocks.where("n IS NOT NULL").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("_blocks"))
    sorted_ = pages.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("n", F.lit("")).alias("n")))).alias("_p"))
    kind = pages.schema["page_no"].dataType.simpleString()
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<end:int,page_no:{kind}>>").alias("ends"))
    add = lambda acc, p: F.struct((acc["at"] + F.length(p["n"])).alias("at"), F.array_append(acc["ends"], F.struct((acc["at"] + F.length(p["n"])).alias("end"), p["page_no"].alias("page_no"))).alias("ends"))
    texts = sorted_.select("version_id", F.array_join(F.transform("_p", lambda p: p["n"]), "").alias("_full"), F.aggregate("_p", begin, add)["ends"].alias("_pages"))
    rows = own.join(texts, "version_id").select("version_id", "_pages", _placed(F.col("_blocks"), F.col("_full")).alias("_b")).select("version_id", "_pages", F.inline("_b")).withColumn("size", F.length("n"))
    # Only what neither way has found is compared by edits, in the text up to the next block that was.
    near = rows.select("version_id", "idx", "size", "_pages", "start", "stop", "low", _nearest(F.col("n"), F.col("window")).alias("_r"))
    close = (1 - F.col("_r.edits") / F.col("size")) * 100 >= threshold
    stop = F.col("low") + F.col("_r.end")
    return near.select("version_id", "idx", F.coalesce("start", F.when(close, F.greatest(F.col("low"), stop - F.col("size")))).alias("start"), F.coalesce("stop", F.when(close, stop)).alias("stop"), "_pages").where("start IS NOT NULL")


def align_pages(blocks: DataFrame, pages: DataFrame, threshold: float = 90.0) -> DataFrame:
    """``blocks`` with page and page_end found by their text; page_end only where it differs.

    Texts and blocks of a document meet in one row. Runs of characters that both have once
    give places, of which the longest chain in the order of blocks counts. Blocks between
    two of the chain are looked for between them, as they are, white space aside, each
    behind the one before: first about where those before it leave off, then anywhere. What
    is left is placed where it takes the fewest edits, if these leave ``threshold`` percent. What is not found has no page. Blocks
    without text keep what they have.
    """
    own = blocks.select("version_id", F.col("idx").cast("int").alias("idx"), X.normalise(F.col("text")).alias("n"))
    theirs = pages.select("version_id", "page_no", X.normalise(F.col("text")).alias("n"))
    page = lambda at: F.get(F.col("_pages"), F.least(F.size(F.filter("_pages", lambda p: p["end"] <= at)), F.size("_pages") - 1))["page_no"]
    paged = _located(own, theirs, threshold).select("version_id", "idx", page(F.col("start")).alias("_first"), page(F.col("stop") - 1).alias("_last"))
    blank = F.col("_blank")
    keep = [c for c in blocks.columns if c not in ("page", "page_end")]
    # Told before the join, so that texts that nobody asks for are not dealt again.
    told = blocks.withColumn("_blank", X.normalise(F.col("text")) == "")
    return told.join(paged, ["version_id", "idx"], "left").select(*keep, F.when(blank, F.col("page")).otherwise(F.col("_first")).alias("page"), F.when(blank, F.col("page_end")).when(F.col("_last") != F.col("_first"), F.col("_last")).alias("page_end"))


def pages_at(offsets: DataFrame, positions: DataFrame) -> DataFrame:
    """The page of each position (version_id, offset); past the end it is the last page."""
    last = offsets.groupBy("version_id").agg(F.max("end").alias("_end"), F.max("page_no").alias("_last"))
    inside = positions.join(last, "version_id").withColumn("_at", F.least("offset", F.col("_end") - 1))
    o = offsets.alias("o")
    return inside.alias("p").join(o, (F.col("p.version_id") == F.col("o.version_id")) & (F.col("p._at") >= F.col("o.start")) & (F.col("p._at") < F.col("o.end")), "left").select("p.version_id", "p.offset", F.coalesce("o.page_no", "p._last").alias("page_no"))



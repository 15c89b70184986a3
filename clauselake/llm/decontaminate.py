"""Benchmark decontamination with an Aho-Corasick automaton over word windows.

Items and texts are normalised alike: A-Z lower-cased, words being maximal runs of
letters, digits and non-ASCII bytes. Every window of an item is a pattern over word
numbers, two signs each (a word that no item has is number 0), and each text is scanned
once. Hits are spans of words, which are carried back to byte offsets in the text as it was.

An automaton takes some hundred times the bytes of its items, so items are cut into parts
of bounded bytes, a long item into pieces that overlap by a window less a word. Every
part has an automaton of its own, which a worker builds once; texts are scanned once a
part, and a row's spans and items are united over all parts before they are counted.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_words, as_table, text_slices, word_ranges

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes between words: ASCII but digits and letters.
STOPS = np.zeros(256, dtype=bool)
STOPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_HITS = "spans array<struct<first:int,last:int>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text``, lower-cased in A-Z."""
    return _WORDS.findall((text or "").encode("utf-8", "replace").lower())


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: (first row, row after the last, hashes, first byte and byte after the last of every word, first word of each text and the end)."""
    for first, last, data, offsets in text_slices(column):
        low = LOWER[data]
        start, end, owner = word_ranges(low, offsets, STOPS)
        at = np.searchsorted(owner, np.arange(last - first + 1))
        own = np.repeat(offsets[:-1], np.diff(at))
        yield first, last, hash_words(low, start, end), start - own, end - own, at


class Automaton:
    """One automaton over the windows of a part's items, by word numbers."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + width]), set()).add(item_id)
        known = sorted({w for window in owners for w in window})
        joined = b" ".join(known)
        ends = np.cumsum([len(w) + 1 for w in known], dtype=np.int64) - 1
        hashes = hash_words(np.frombuffer(joined, np.uint8), ends - [len(w) for w in known], ends) if known else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order + 1
        self.base = math.isqrt(len(known)) + 1
        number = {w: k + 1 for k, w in enumerate(known)}
        self.found = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.found.add_word(self.signs(np.array([number[w] for w in window])), (len(window), tuple(sorted(ids))))
        if owners:
            self.found.make_automaton()

    def signs(self, numbers: np.ndarray) -> str:
        """Two signs a word, of alphabets of their own, so that no node has many children."""
        return np.stack((numbers // self.base + 1, numbers % self.base + self.base + 3), axis=1).astype("<u4").tobytes().decode("utf-32-le")

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those of no item."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, word after the last) of the windows in a text, and their items."""
        spans, ids = [], set()
        if not len(self.hashes) or not numbers.any():
            return spans, ids
        for sign, (length, owners) in self.found.iter(self.signs(numbers)):
            end = (sign + 1) // 2
            spans.append((end - length, end))
            ids.update(owners)
        return spans, ids


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with touching and overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


_built: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], width: int) -> Automaton:
    """The part's automaton; a worker keeps the last one it built."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, width)
    return _built[key]


def _pieces(width: int, part_bytes: int):
    """Items cut into pieces of at most ``part_bytes`` (or a window, if that is longer), which share width - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
                if len((text or "").encode("utf-8", "replace")) <= part_bytes:
                    ids.append(item_id)
                    texts.append(text)
                    continue
                words = words_of(text)
                ends, first = np.cumsum([len(w) + 1 for w in words]), 0
                while first < len(words):
                    before = int(ends[first - 1]) if first else 0
                    last = min(len(words), max(first + width, int(np.searchsorted(ends, before + part_bytes, side="right"))))
                    ids.append(item_id)
                    texts.append(b" ".join(words[first:last]).decode("utf-8", "replace"))
                    if last == len(words):
                        break
                    first = last - width + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "item_text"])

    return run


def _parts(items: DataFrame, width: int, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in parts of about ``part_bytes``; the driver holds one part at a time."""
    pieces = items.mapInArrow(_pieces(width, part_bytes), "item_id string, item_text string")
    total = pieces.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    n = -(-total // part_bytes) or 1
    if n > 1:
        pieces = as_table(pieces.withColumn("_part", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)).cast("int")), "items")
    for k in range(n):
        own = pieces if n == 1 else pieces.where(F.col("_part") == k)
        yield sorted((r.item_id, r.item_text) for r in own.select("item_id", "item_text").collect())


def _hits_of(automaton: Automaton, column: pa.Array) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """word_hashes() with each text's united spans and items in place of the hashes."""
    for first, last, hashes, start, end, at in word_hashes(column):
        numbers = automaton.number(hashes)
        found = [automaton.scan(numbers[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield first, last, [(unite(spans), sorted(ids)) for spans, ids in found], start, end, at


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_COUNTS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def _counted(row: pa.Array, hits: list[tuple[list[tuple[int, int]], list[str]]], start: np.ndarray, end: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    spans = [[{"start": int(start[a + i]), "end": int(end[a + j - 1])} for i, j in own] for a, (own, _) in zip(at[:-1], hits, strict=True)]
    columns = [row, pa.array(np.diff(at), pa.int64()), pa.array([sum(j - i for i, j in own) for own, _ in hits], pa.int64()), pa.array([ids for _, ids in hits], pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))]
    return pa.RecordBatch.from_arrays(columns, names=["_row", "n_words", "n_hit", "item_ids", "spans"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    part_bytes: int = 1 << 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Marks what each document shares with the benchmark.

    Returns one row per input row: doc_id, n_words, n_hit (words inside any window of an
    item), item_ids (sorted as strings), spans (hit byte ranges of the UTF-8 text, as
    maximal runs of hit words) and the input columns named in ``carry`` in a struct
    ``carried``.

    A null or empty text has no words. Items without words or with a null id are left
    out; an id on several rows owns the windows of all. Columns of other names are
    ignored. Empty tables are allowed on either side. Texts are scanned whole; repeated
    rows are each marked.

    What goes to every worker is one part of the benchmark, about ``part_bytes`` of it.
    With several parts the rows are written once with a key, every part's hits are found
    by a scan of its own, and united by that key.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text"))
    kept = F.struct(F.col(id_col).alias("doc_id"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else [])).alias("_row")
    rows = docs.select(kept, F.col(text_col).cast("string").alias("_text"))
    counted = f"_row {rows.schema['_row'].dataType.simpleString()}, {_COUNTS}"
    parts = _parts(items, width, part_bytes)
    first_part, second_part = next(parts), next(parts, None)

    def whole(key: str, part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, part.value, width)
            for batch in batches:
                for first, last, hits, start, end, at in _hits_of(automaton, batch.column("_text")):
                    yield _counted(batch.column("_row").slice(first, last - first), hits, start, end, at)

        return run

    def hits_only(key: str, part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, part.value, width)
            for batch in batches:
                for first, last, hits, _, _, _ in _hits_of(automaton, batch.column("_text")):
                    own = [k for k, (spans, _) in enumerate(hits) if spans]
                    spans = [[{"first": i, "last": j} for i, j in hits[k][0]] for k in own]
                    yield pa.RecordBatch.from_arrays([batch.column("_key").slice(first, last - first).take(pa.array(own, pa.int64())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([hits[k][1] for k in own], pa.list_(pa.string()))], names=["_key", "spans", "item_ids"])

        return run

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, start, end, at in word_hashes(batch.column("_text")):
                spans, ids = (batch.column(c).slice(first, last - first).to_pylist() for c in ("_spans", "_ids"))
                hits = [(unite([(s["first"], s["last"]) for s in own or []]), sorted(set(own_ids or []))) for own, own_ids in zip(spans, ids, strict=True)]
                yield _counted(batch.column("_row").slice(first, last - first), hits, start, end, at)

    if second_part is None:
        found = rows.mapInArrow(whole(uuid.uuid4().hex, spark.sparkContext.broadcast(first_part)), counted)
    else:
        keyed = as_table(rows.withColumn("_key", F.monotonically_increasing_id()), "rows")
        hits = None
        for part in (p for head in ([first_part, second_part], parts) for p in head):
            sent = spark.sparkContext.broadcast(part)
            own = as_table(keyed.select("_key", "_text").mapInArrow(hits_only(uuid.uuid4().hex, sent), f"_key long, {_HITS}"), "hits")
            sent.unpersist()
            hits = own if hits is None else hits.unionByName(own)
        merged = hits.groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("_ids"))
        found = keyed.join(merged, "_key", "left").select("_row", "_text", "_spans", "_ids").mapInArrow(united, counted)
    return found.select("_row.doc_id", "n_words", "n_hit", "item_ids", "spans", *(["_row.carried"] if carry else []))

"""Language-model scoring with a log-frequency Bloom filter.

N-grams of up to three tokens are counted over all training texts in hash buckets. The
filter holds a count c as the events (n-gram, 1) ... (n-gram, level of c), levels being
the ranges of powers of 1.5; a count is read back by probing level after level until one
is missing, so an error can only raise it, and each further level at a falling rate. Every
bucket builds its own segment, of all counts from 1, and writes it to a table that grows
with the training texts. A size bound decides how segments are read and nothing else: up
to it every worker loads them all from the shared folder (a broadcast that spares the
driver), beyond it each block of texts sends its distinct n-grams to their buckets.

The model interpolates three orders over words and one end token per text:
    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    pk(w | h) = (1 - b) c(h w) / c(h) + b p(k-1)(w | h'),   b by k and the level of c(h).
The weight b of the lower order is the chance of a new word after contexts of that level,
by leaving one out: the share of training tokens after such contexts whose n-gram occurs
just once. Bloom errors are kept down by c(u v w) <= c(u v), c(v w) and c(v w) <= c(v), c(w).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import LOWER, as_table, fold_of, fresh_path, hash_words, mix64, open_fs, text_slices, word_ranges

ORDERS = 3
BITS_PER_EVENT = 12
PROBES = 5
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_LOW = np.uint64(0xFFFFFFFF)
#: Bytes of text whose distinct n-grams are looked up at once.
LOOKED_UP_BYTES = 2 << 20
#: The least count of each level from 1, by powers of 1.5: 1, 2, 3, 4, 6, 8, 12 ...
LEAST = np.ceil(1.5 ** np.arange(100) - 1e-9)
#: What a level reads back as: the middle of its range; 0 for level 0.
VALUES = np.concatenate(([0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2))
N_LEVELS = len(VALUES)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for 0."""
    return np.searchsorted(LEAST, counts, side="right")


def tokens_of(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: (first row, row after the last, token hashes, first token of each text and the end).

    Every text, a null one too, ends with the END token.
    """
    for first, last, data, offsets in text_slices(column, max_bytes):
        low = LOWER[data]
        start, end, owner = word_ranges(low, offsets)
        words = hash_words(low, start, end)
        bounds = np.searchsorted(owner, np.arange(last - first + 1))
        tokens = np.insert(words, bounds[1:], END)
        yield first, last, tokens, bounds + np.arange(last - first + 1)


def ngrams_of(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-grams of 1, 2 and 3 tokens that end at each token.

    A text starts after START; the first token has no trigram, and its key there is that
    of its bigram, which is ignored.
    """
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    two = mix64(before * np.uint64(0xDA942042E4DD58B5) + tokens)
    three = np.empty_like(two)
    three[1:] = mix64((two[:-1] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) + tokens[1:])
    three[bounds[:-1]] = two[bounds[:-1]]
    return [tokens, two, three]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(n)


def _own_keys(keys: np.ndarray, kind: int) -> np.ndarray:
    """What a bucket keeps of a key: all of a word's, the low 32 bits of longer n-grams'."""
    return keys if kind == 0 else keys & _LOW


def _pack(keys: np.ndarray, kind: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, keys and their counts) for each bucket that gets keys."""
    if kind == 0:
        found, counts = np.unique(keys, return_counts=True)
        bucket = _bucket(found, n_buckets)
        order = np.argsort(bucket, kind="stable")
        found, counts, bucket = found[order], counts[order], bucket[order]
    else:
        found, counts = np.unique(_bucket(keys, n_buckets) << np.uint64(32) | keys & _LOW, return_counts=True)
        found, bucket = (found & _LOW).astype(np.uint32), found >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets)))
    for a, b in zip(first, np.append(first[1:], len(found))):
        own = counts[a:b]
        over = np.flatnonzero(own > 255).astype(np.uint32)
        yield kind, int(bucket[a]), b"".join((np.uint32(b - a).tobytes(), found[a:b].tobytes(), np.minimum(own, 255).astype(np.uint8).tobytes(), over.tobytes(), own[over].astype(np.uint32).tobytes()))


def _unpack(payload: bytes, kind: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, np.uint32, 1)[0])
    width = 8 if kind == 0 else 4
    keys = np.frombuffer(payload, np.uint64 if kind == 0 else np.uint32, n, 4)
    counts = np.frombuffer(payload, np.uint8, n, 4 + width * n).astype(np.int64)
    at = 4 + (width + 1) * n
    n_over = (len(payload) - at) // 8
    counts[np.frombuffer(payload, np.uint32, n_over, at)] = np.frombuffer(payload, np.uint32, n_over, at + 4 * n_over)
    return keys, counts


def _gather(n_buckets: int, flush: int = 2_000_000):
    """Counts of n-grams by order, summed over ``flush`` tokens at a time."""

    def rows(held: list[list[np.ndarray]], kind: int) -> pa.RecordBatch:
        found = list(_pack(np.concatenate(held[kind]), kind, n_buckets))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["kind", "bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(ORDERS)], 0
        for batch in batches:
            for _, _, tokens, bounds in tokens_of(batch.column("_text")):
                keys = ngrams_of(tokens, bounds)
                keys[2] = np.delete(keys[2], bounds[:-1])
                for own, new in zip(held, keys, strict=True):
                    own.append(new)
                n += len(tokens)
                if n >= flush:
                    yield from (rows(held, kind) for kind in range(ORDERS))
                    held, n = [[] for _ in range(ORDERS)], 0
        if n:
            yield from (rows(held, kind) for kind in range(ORDERS))

    return run


def _sum_bucket(bits_per_event: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        parts = [_unpack(p.as_py(), kind) for p in table.column("payload")]
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        bits = build_segment(keys.astype(np.uint64), counts, bits_per_event)
        powers = np.bincount(np.log2(counts).astype(np.int64) + 1, minlength=64)
        n, total = len(keys), int(counts.sum())
        if kind:
            keys, counts = keys[:0], counts[:0]
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "bits": pa.array([bits], pa.binary()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "powers": pa.array([powers.tolist()], pa.list_(pa.int64()))})

    return run


def _event_hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the event (key, level); probe k reads the bit of the first plus k times the second."""
    first = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return first, first * np.uint64(0xD1342543DE82EF95) | np.uint64(1)


def _place(hashes: np.ndarray, n_bits: np.ndarray | np.uint64) -> np.ndarray:
    """A bit number under ``n_bits`` (which 32 bits must hold)."""
    return (hashes >> np.uint64(32)) * n_bits >> np.uint64(32)


def build_segment(keys: np.ndarray, counts: np.ndarray, bits_per_event: int = BITS_PER_EVENT) -> bytes:
    """The filter's segment for one bucket: the events of all its n-grams."""
    levels = levels_of(counts)
    n_bits = max(64, -(-int(levels.sum()) * bits_per_event // 64) * 64)
    bits = np.zeros(n_bits, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        hashes, step = _event_hashes(keys[levels >= level], level)
        for _ in range(PROBES):
            bits[_place(hashes, np.uint64(n_bits)).astype(np.int64)] = True
            hashes = hashes + step
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """Segments of all (kind, bucket) pairs, one after another."""

    n_buckets: int
    data: np.ndarray
    offsets: np.ndarray  # of each segment's first bit, by kind * n_buckets + bucket
    n_bits: np.ndarray

    def _holds(self, hashes: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The filter's bits at ``hashes``, as the lowest bit of a byte."""
        bit = base + _place(hashes, size)
        return self.data[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The last level found of each key, 0 if none is."""
        segment = kind * self.n_buckets + _bucket(keys, self.n_buckets).astype(np.int64)
        level_of = np.zeros(len(keys), dtype=np.int64)
        at = np.flatnonzero(self.n_bits[segment] > 0)
        key, size, base, level = _own_keys(keys, kind)[at], self.n_bits[segment[at]].astype(np.uint64), self.offsets[segment[at]].astype(np.uint64), 1
        while len(at) and level < N_LEVELS:
            hashes, step = _event_hashes(key, level)
            # About half of the missing ones go at the first probe; the others are few enough to be probed to the end.
            found = np.flatnonzero(self._holds(hashes, base, size) & 1)
            if len(found) < len(at):
                at, key, size, base, hashes, step = at[found], key[found], size[found], base[found], hashes[found], step[found]
            hit = np.ones(len(at), dtype=np.uint8)
            for _ in range(PROBES - 1):
                hashes += step
                hit &= self._holds(hashes, base, size)
            found = np.flatnonzero(hit)
            if len(found) < len(at):
                at, key, size, base = at[found], key[found], size[found], base[found]
            level_of[at] = level
            level += 1
        return level_of


_mapped: dict[str, np.ndarray] = {}


def write_filter(segments: DataFrame, n_buckets: int) -> tuple[str, np.ndarray, np.ndarray]:
    """Streams all segments into one file of the shared folder: its path, and offsets and sizes in bits.

    Only for a filter within its bound: this is the driver's half of a broadcast, and it
    holds one partition of the table at a time.
    """
    path = fresh_path(segments.sparkSession, "filter")
    store, inner = open_fs(path)
    n_bits, offsets, at = np.zeros(ORDERS * n_buckets, np.int64), np.zeros(ORDERS * n_buckets, np.int64), 0
    with store.open_output_stream(inner) as out:
        for row in segments.toLocalIterator():
            segment = row.kind * n_buckets + row.bucket
            n_bits[segment], offsets[segment], at = len(row.bits) * 8, at * 8, at + len(row.bits)
            out.write(bytes(row.bits))
    return path, offsets, n_bits


def mapped(path: str) -> np.ndarray:
    """The bytes of the filter; a worker loads them once, and maps them where the folder is mounted."""
    if path not in _mapped:
        _mapped.clear()
        store, inner = open_fs(path)
        if isinstance(store, fs.LocalFileSystem):
            _mapped[path] = np.frombuffer(pa.memory_map(inner).read_buffer(), np.uint8)
        else:
            with store.open_input_stream(inner) as raw:
                _mapped[path] = np.frombuffer(raw.read(), np.uint8)
    return _mapped[path]


@dataclass
class LanguageModel:
    train_tokens: int
    vocabulary: int
    n_texts: int
    n_buckets: int
    path: str | None  # of the filter's file; None if it stays in its table
    offsets: np.ndarray
    n_bits: np.ndarray
    head_keys: np.ndarray
    head_counts: np.ndarray
    back_off: np.ndarray = field(default_factory=lambda: np.ones((ORDERS, N_LEVELS)))  # by order - 1 and level of the context
    tail: DataFrame | None = field(default=None)
    segments: DataFrame | None = field(default=None)  # (kind, bucket, bits)

    @property
    def denominator(self) -> float:
        return self.train_tokens + 0.5 * (self.vocabulary + 1)

    @property
    def whole(self) -> bool:
        """Whether workers load the whole filter."""
        return self.path is not None

    def filter(self) -> LogFrequencyFilter:
        return LogFrequencyFilter(self.n_buckets, mapped(self.path), self.offsets, self.n_bits)

    def sent(self) -> LanguageModel:
        """The part that tasks need."""
        return LanguageModel(self.train_tokens, self.vocabulary, self.n_texts, self.n_buckets, self.path, self.offsets, self.n_bits, self.head_keys, self.head_counts, self.back_off)


# --------------------------------------------------------------------- reading counts


@dataclass
class Levels:
    """Levels of the n-grams that end at each token, and of their contexts."""

    grams: list[np.ndarray]
    contexts: list[np.ndarray]  # of orders 2 and 3 at places 1 and 2


def clipped(l1: np.ndarray, l2: np.ndarray, l3: np.ndarray, bounds: np.ndarray, n_texts: int) -> Levels:
    """Levels lowered to those of the parts of each n-gram; heads of texts have no trigram."""
    heads = bounds[:-1]
    before1 = np.concatenate(([0], l1[:-1]))
    before1[heads] = levels_of(np.array([n_texts]))[0]
    l2 = np.minimum(l2, np.minimum(l1, before1))
    before2 = np.concatenate(([0], l2[:-1]))
    before2[heads] = 0
    return Levels([l1, l2, np.minimum(l3, np.minimum(l2, before2))], [before1, before1, before2])


def log_probabilities(levels: Levels, back_off: np.ndarray, denominator: float) -> np.ndarray:
    """log10 p(token | two tokens before) of every token."""
    p = (VALUES[levels.grams[0]] + 0.5) / denominator
    for k in (1, 2):
        context = levels.contexts[k]
        b = np.where(context > 0, back_off[k][context], 1.0)
        p = (1 - b) * VALUES[levels.grams[k]] / np.maximum(VALUES[context], 1.0) + b * p
    return np.log10(p)


def count_new(levels: Levels) -> np.ndarray:
    """Tokens by order, level of the context, and whether the n-gram occurs once."""
    out = np.zeros((ORDERS, N_LEVELS, 2), dtype=np.int64)
    for k in (1, 2):
        seen = levels.grams[k] > 0
        out[k] = np.bincount(levels.contexts[k][seen] * 2 + (levels.grams[k][seen] == 1), minlength=2 * N_LEVELS).reshape(-1, 2)
    return out


def back_off_weights(counts: np.ndarray) -> np.ndarray:
    """Weights of the lower order, by order and level of the context, from count_new().

    Leaving one out, a context of count n stands among those of n - 1; so the levels of
    one count each (1 to 3) read the level after their own.
    """
    after = np.arange(N_LEVELS)
    after[1:4] += 1
    total = counts.sum(axis=2)
    share = (counts[:, :, 1] + 0.5) / (total + 1.0)
    return np.clip(share[:, after], 1e-4, 1.0)


def _distinct_levels(bloom: LogFrequencyFilter, keys: np.ndarray, kind: int, ask: np.ndarray | None = None) -> np.ndarray:
    """Levels of ``keys`` (0 where ``ask`` is false), each distinct one probed once."""
    out = np.zeros(len(keys), dtype=np.int64)
    at = np.flatnonzero(ask) if ask is not None else slice(None)
    found, of = np.unique(keys[at], return_inverse=True)
    out[at] = bloom.levels(found, kind)[of]
    return out


def read_levels(bloom: LogFrequencyFilter, tokens: np.ndarray, bounds: np.ndarray, n_texts: int) -> Levels:
    """Levels by probing; an n-gram is probed only if its parts are there."""
    one, two, three = ngrams_of(tokens, bounds)
    l1 = _distinct_levels(bloom, one, 0)
    before = np.concatenate(([0], l1[:-1]))
    before[bounds[:-1]] = n_texts
    l2 = _distinct_levels(bloom, two, 1, (l1 > 0) & (before > 0))
    before = np.concatenate(([0], l2[:-1]))
    before[bounds[:-1]] = 0
    return clipped(l1, l2, _distinct_levels(bloom, three, 2, (l2 > 0) & (before > 0)), bounds, n_texts)


def _packed_levels(levels: Levels, bounds: np.ndarray) -> pa.Array:
    """The levels of each text as bytes, three a token; contexts are told by the tokens before."""
    data = np.stack(levels.grams, axis=1).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((3 * bounds).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _unpacked_levels(column: pa.Array, n_texts: int) -> Iterator[tuple[Levels, np.ndarray]]:
    """Levels of runs of texts, and the first token of each text and the end."""
    for _, _, data, offsets in text_slices(column):
        yield clipped(*data.reshape(-1, 3).T.astype(np.int64), offsets // 3, n_texts), offsets // 3


def _vocabulary_part(low: int, high: int, packed: bool):
    """Unigrams with a count in [low, high), as one packed row a bucket or as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
                keep = (counts >= low) & (counts < high)
                if packed:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[keep].tobytes()], pa.binary()), pa.array([counts[keep].tobytes()], pa.binary())], names=["keys", "counts"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64), pa.int64()), pa.array(counts[keep], pa.int64())], names=["token", "c"])

    return run


def count_ngrams(docs: DataFrame, *, text_col: str = "text", head_words: int = 1_000_000, filter_bytes: int = 256 << 20, bucket_bytes: int = 8 << 20, bits_per_event: int = BITS_PER_EVENT) -> LanguageModel:
    """Counts n-grams of all rows of ``docs`` and builds the filter; back-off weights are yet to be fitted.

    Two bounds hold what every worker gets: ``head_words`` exact word counts (those of at
    least the smallest power of two that fits), the rest staying in a table to be joined;
    and ``filter_bytes``: a larger filter stays in its table, to be probed there. Neither
    changes what is stored or any result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count("*")).first()
    n_buckets = size[0] // bucket_bytes + 1
    path = fresh_path(spark, "ngrams")
    gathered = texts.mapInArrow(_gather(n_buckets), "kind int, bucket int, payload binary")
    gathered.groupBy("kind", "bucket").applyInArrow(_sum_bucket(bits_per_event), "kind int, bucket int, keys binary, counts binary, bits binary, n long, total long, powers array<long>").write.parquet(path)
    counted = spark.read.schema("kind int, bucket int, keys binary, counts binary, bits binary, n long, total long, powers array<long>").parquet(path)
    powers = {r.power: r.n for r in counted.where("kind = 0").select(F.posexplode("powers").alias("power", "n")).groupBy("power").agg(F.sum("n").alias("n")).collect()}
    known = counted.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.sum(F.when(F.col("kind") == 0, F.col("total"))), F.sum(F.octet_length("bits"))).first()

    head = 1
    while sum(n for power, n in powers.items() if power >= head) > head_words:
        head += 1
    unigrams = counted.where("kind = 0").select("keys", "counts")
    got = unigrams.mapInArrow(_vocabulary_part(1 << (head - 1), 1 << 62, True), "keys binary, counts binary").collect()
    keys = np.frombuffer(b"".join(bytes(r.keys) for r in got), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in got), np.int64)
    order = np.argsort(keys)
    tail = unigrams.mapInArrow(_vocabulary_part(1, 1 << (head - 1), False), "token long, c long") if head > 1 else None
    segments = counted.select("kind", "bucket", "bits")
    written = write_filter(segments, n_buckets) if 0 < (known[2] or 0) <= filter_bytes else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    return LanguageModel(known[1] or 0, known[0] or 0, size[1], n_buckets, *written, keys[order], counts[order], tail=tail, segments=segments)


def learn_model(docs: DataFrame, *, text_col: str = "text", **bounds: int) -> LanguageModel:
    """A model of all rows of ``docs``; ``bounds``: those of count_ngrams()."""
    model = count_ngrams(docs, text_col=text_col, **bounds)
    model.back_off = _fit_back_off(_looked_up(docs.select(F.lit(None).alias("_row"), F.col(text_col).cast("string").alias("_text")), model), model)
    return model


def learn_and_score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, **bounds: int) -> DataFrame:
    """score_texts() of all rows of ``docs`` by the model of those where ``training`` holds.

    Every n-gram is looked up once: the levels of all rows are written, the back-off
    weights are fitted to those of the training rows, and all are scored by them.
    """
    model = count_ngrams(docs.where(training), text_col=text_col, **bounds)
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("_row"), F.col(text_col).cast("string").alias("_text"), training.alias("_train"))
    looked_up = as_table(_looked_up(rows, model, block_bytes), "levels")
    model.back_off = _fit_back_off(looked_up.where("_train"), model)
    return _scored(looked_up, model)


def _fit_back_off(looked_up: DataFrame, model: LanguageModel) -> np.ndarray:
    """Back-off weights from one pass over the levels of all training texts."""
    n_texts = model.n_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDERS * N_LEVELS * 2, dtype=np.int64)
        for batch in batches:
            for levels, _ in _unpacked_levels(batch.column("levels"), n_texts):
                total += count_new(levels).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    counts = np.zeros(ORDERS * N_LEVELS * 2, dtype=np.int64)
    for r in looked_up.select("levels").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    return back_off_weights(counts.reshape(ORDERS, N_LEVELS, 2))


# ------------------------------------------------- a filter that stays in its table


def _dealt(rows: DataFrame, *by: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Rows with the number of their block, of about ``block_bytes`` of text; equal rows share a block."""
    n_blocks = (rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // block_bytes + 1
    return rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(n_blocks)))


def _by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of their buckets, the bucket of each, the key of each place."""
    found, of = np.unique(keys, return_inverse=True)
    bucket = _bucket(found, n_buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return found[order], bucket[order], rank[of]


def _block_tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts of a block, and the first token of each text and the end."""
    runs = [(tokens, bounds) for _, _, tokens, bounds in tokens_of(column)]
    starts = np.cumsum([0, *(len(t) for t, _ in runs)])
    return np.concatenate([t for t, _ in runs]), np.concatenate([*(b[:-1] + s for (_, b), s in zip(runs, starts)), starts[-1:]])


def _block_probes(n_buckets: int):
    """The distinct n-grams of a block: one row (block, kind, bucket, keys) for each bucket they fall to."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, buckets, packed = [], [], []
        for kind, all_keys in enumerate(ngrams_of(*_block_tokens(table.column("_text")))):
            keys, bucket, _ = _by_bucket(all_keys, n_buckets)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(first, np.append(first[1:], len(keys))):
                kinds.append(kind)
                buckets.append(int(bucket[a]))
                packed.append(keys[a:b].tobytes() if kind == 0 else (keys[a:b] & _LOW).astype(np.uint32).tobytes())
        return pa.table({"block": pa.array([key[0].as_py()] * len(kinds), pa.int64()), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "keys": pa.array(packed, pa.binary())})

    return run


def _probe_bucket(probes: pa.Table, segments: pa.Table) -> pa.Table:
    """The levels that a bucket's segment holds of the keys of each probe."""
    bits = np.frombuffer(segments.column("bits")[0].as_py(), np.uint8) if segments.num_rows else np.zeros(1, np.uint8)
    size = len(bits) * 8 if segments.num_rows else 0
    bloom = LogFrequencyFilter(1, bits, np.zeros(ORDERS, np.int64), np.full(ORDERS, size, np.int64))
    levels = []
    for kind, packed in zip(probes.column("kind").to_pylist(), probes.column("keys"), strict=True):
        keys = np.frombuffer(packed.as_py(), np.uint64 if kind == 0 else np.uint32).astype(np.uint64)
        levels.append(bloom.levels(keys, kind).astype(np.uint8).tobytes())
    return pa.table({"block": probes.column("block"), "kind": probes.column("kind"), "bucket": probes.column("bucket"), "levels": pa.array(levels, pa.binary())})


def _block_levels(model: LanguageModel, answers: pa.Table, tokens: np.ndarray, bounds: np.ndarray) -> Levels:
    """read_levels() of a block whose n-grams have been looked up."""
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    kinds = answers.column("kind").to_numpy()
    found = []
    for kind, all_keys in enumerate(ngrams_of(tokens, bounds)):
        keys, _, of = _by_bucket(all_keys, model.n_buckets)
        levels = np.frombuffer(b"".join(answers.column("levels")[int(k)].as_py() for k in np.flatnonzero(kinds == kind)), np.uint8)
        if len(levels) != len(keys):
            raise ValueError("the texts changed between two reads")
        found.append(levels.astype(np.int64)[of])
    return clipped(*found, bounds, model.n_texts)


def _answers(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """(block, kind, bucket, levels) for the distinct n-grams of each block, looked up where their segments are.

    A bucket's probes come merged by block, so no n-gram makes a bucket hot.
    """
    probes = rows.groupBy("block").applyInArrow(_block_probes(model.n_buckets), "block long, kind int, bucket int, keys binary")
    by = ("kind", "bucket")
    return probes.groupBy(*by).cogroup(model.segments.groupBy(*by)).applyInArrow(_probe_bucket, "block long, kind int, bucket int, levels binary")


def _looked_up(rows: DataFrame, model: LanguageModel, block_bytes: int = 8 << 20) -> DataFrame:
    """``rows`` (_row, _text and others) without their texts, and with all of their scores but for the back-off weights.

    Adds serial, n_tokens, n_head and head_score of the words in the head, ``others``, the
    remaining tokens, and levels as _packed_levels() makes them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.sent())
    kept = [c for c in rows.columns if c != "_text"]

    def measured(own: LanguageModel, held: list[pa.Array], serial: int, tokens: np.ndarray, bounds: np.ndarray, levels: Levels) -> pa.RecordBatch:
        n = len(bounds) - 1
        at = np.minimum(np.searchsorted(own.head_keys, tokens), max(0, len(own.head_keys) - 1))
        found = own.head_keys[at] == tokens if len(own.head_keys) else np.zeros(len(tokens), dtype=bool)
        value = np.zeros(len(tokens))
        value[found] = np.log10(own.head_counts[at[found]] + 0.5) - np.log10(own.denominator)
        missing = np.concatenate(([0], np.cumsum(~found)))[bounds]
        return pa.RecordBatch.from_arrays(
            [
                *held,
                pa.array(serial + np.arange(n), pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(np.add.reduceat(found.astype(np.int64), bounds[:-1]), pa.int64()),
                pa.array(np.add.reduceat(value, bounds[:-1]), pa.float64()),
                pa.ListArray.from_arrays(pa.array(missing, pa.int32()), pa.array(tokens[~found].view(np.int64), pa.int64())),
                _packed_levels(levels, bounds),
            ],
            names=[*kept, "serial", "n_tokens", "n_head", "head_score", "others", "levels"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, serial = shared.value, TaskContext.get().partitionId() << 40
        bloom = own.filter()
        for batch in batches:
            for first, last, tokens, bounds in tokens_of(batch.column("_text"), LOOKED_UP_BYTES):
                yield measured(own, [batch.column(c).slice(first, last - first) for c in kept], serial, tokens, bounds, read_levels(bloom, tokens, bounds, own.n_texts))
                serial += last - first

    def run_block(answers: pa.Table, texts: pa.Table) -> pa.Table:
        own = shared.value
        tokens, bounds = _block_tokens(texts.column("_text"))
        return pa.Table.from_batches([measured(own, [texts.column(c).combine_chunks() for c in kept], texts.column("block")[0].as_py() << 32, tokens, bounds, _block_levels(own, answers, tokens, bounds))])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "serial long, n_tokens long, n_head long, head_score double, others array<long>, levels binary"])
    if model.whole:
        return rows.mapInArrow(run, schema)
    rows = _dealt(rows, "_text", "_row", block_bytes=block_bytes)
    return _answers(rows, model).groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run_block, schema)


def _scored(looked_up: DataFrame, model: LanguageModel) -> DataFrame:
    """The result of score_texts() from _looked_up()."""
    back_off, denominator, n_texts = model.back_off, model.denominator, model.n_texts
    names = ["_row", "serial", "n_tokens", "n_head", "head_score", "n_others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.add.reduceat(log_probabilities(levels, back_off, denominator), bounds[:-1]) for levels, bounds in _unpacked_levels(batch.column("levels"), n_texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=[*names, "score"])

    schema = f"_row {looked_up.schema['_row'].dataType.simpleString()}, serial long, n_tokens long, n_head long, head_score double, n_others int, score double"
    scored = looked_up.withColumn("n_others", F.size("others")).select(*names, "levels").mapInArrow(run, schema)
    unseen = float(np.log10(0.5 / model.denominator))
    if model.tail is None:
        scored = scored.withColumns({"n_tail": F.lit(0), "tail_score": F.lit(0.0)})
    else:
        hits = looked_up.select("serial", F.explode("others").alias("token")).join(model.tail, "token")
        sums = hits.groupBy("serial").agg(F.count("*").alias("n_tail"), F.sum(F.log10((F.col("c") + 0.5) / F.lit(model.denominator))).alias("tail_score"))
        scored = scored.join(sums, "serial", "left").fillna({"n_tail": 0, "tail_score": 0.0})
    return scored.select(
        "_row.doc_id",
        "n_tokens",
        (F.col("n_head") + F.col("n_tail")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.col("tail_score") + (F.col("n_others") - F.col("n_tail")) * F.lit(unseen)).alias("base_score"),
        "score",
    )


def score_texts(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Scores every row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is exact: sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and
    the end token; frequent words are looked up in the head, the others joined to the tail
    of the vocabulary. ``score`` is the model's log10 probability; it is the same whether
    workers load the filter or probe it in its table. For the latter, texts are dealt by
    hash into blocks of about ``block_bytes``.

    A null or empty text has the end token alone. A null id and repeated rows are kept.
    Columns of other names are ignored. A model of no text is allowed (N = V = 0).
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    looked_up = _looked_up(rows, model, block_bytes)
    return _scored(looked_up if model.tail is None else as_table(looked_up, "levels"), model)


def in_training(id_col: Column, folds: int = 5, held_out_fold: int = 1) -> Column:
    """Whether a row is not in ``held_out_fold`` of crc32(id as text) modulo ``folds``; null ids are in fold 0."""
    return fold_of(id_col, folds) != held_out_fold


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 5, held_out_fold: int = 1) -> DataFrame:
    """The rows of ``docs`` that are in_training()."""
    return docs.where(in_training(F.col(id_col), folds, held_out_fold))

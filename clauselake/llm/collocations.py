"""Phrases that hold together, mined from compressed position bitmaps.

Texts of one language are gathered into shards of bounded bytes. In a shard every word
has a bitmap of its positions, and a free position stands between two pieces of text.
Only blocks of 16 positions that hold a word are kept for it. A phrase grows by a word
when its bitmap, shifted by one, is ANDed with the word's; popcounts are summed over
shards.

A shard cannot know what is frequent everywhere. So words, pairs and triples are first
counted by hash, and a filter of bounded size says of each whether it may be frequent: one
bit for the hash of a frequent one. Hashes that meet only let more through. Then every
shard extends its phrases depth-first, as far as the filters let it, and what it finds is
summed by the words themselves. Shards stay where they are; only counts are shuffled,
those of a task summed up before, one packed row for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, as_table, cut, mix64, text_slices, word_ranges

#: Bytes that end a piece, and bytes that end a word.
PIECE = np.zeros(256, dtype=bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
STOP = PIECE.copy()
STOP[[0x20, 0x09]] = True
#: Positions in a block of a bitmap.
BLOCK = 16

# ------------------------------------------------------------- shards


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def bitmaps(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, count of each, first entry of each, block and bits of each entry) of the lower-cased bytes."""
    start, end, _ = word_ranges(data, np.array([0, len(data)]), STOP)
    if not len(start):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(4))
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    encoded = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[~STOP[data]])).dictionary_encode()
    word = encoded.indices.to_numpy().astype(np.int64)
    piece = np.cumsum(PIECE[data])[start]
    place = np.arange(len(start)) + np.append(0, np.cumsum(piece[1:] != piece[:-1]))
    order = np.argsort(word, kind="stable")
    word, place = word[order], place[order]
    block = place // BLOCK
    opens = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])))
    bits = np.bitwise_or.reduceat(np.uint16(1) << (place % BLOCK).astype(np.uint16), opens)
    first = np.searchsorted(word[opens], np.arange(len(encoded.dictionary)))
    return encoded.dictionary, np.bincount(word), first, block[opens], bits


_SHARDS = "lang string, words array<string>, counts array<long>, n_entries long, first binary, blocks binary, bits binary"


def _cut_long(text: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text in runs of about ``most`` bytes that end where pieces end; a longer piece stays whole."""
    while len(text) > most:
        ends = np.flatnonzero(PIECE[text[most:]])
        if not len(ends):
            break
        yield text[: most + ends[0]]
        text = text[most + ends[0] :]
    yield text


def _shards(shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gap = np.frombuffer(b"\n", dtype=np.uint8)

    def flushed(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            words, counts, first, blocks, bits = bitmaps(LOWER[np.concatenate([x for t in texts for x in (t, gap)])])
            if len(words):
                all_ = pa.array([0, len(words)], pa.int32())
                lists = [pa.ListArray.from_arrays(all_, words), pa.ListArray.from_arrays(all_, pa.array(counts, pa.int64()))]
                packed = [[_packed(x)] for x in (first.astype(np.int32), np.diff(blocks, prepend=0).astype(np.int32), bits)]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([len(bits)]), *map(pa.array, packed)], names=["lang", "words", "counts", "n_entries", "first", "blocks", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, last, data, offsets in text_slices(batch.column("text")):
                for row in range(first, last):
                    text = data[offsets[row - first] : offsets[row - first + 1]]
                    for part in _cut_long(text, shard_bytes):
                        held.setdefault(langs[row], []).append(part.copy())
                        size += len(part) + 1
                        if size >= shard_bytes:
                            yield from flushed(held)
                            held, size = {}, 0
        yield from flushed(held)

    return run


# ------------------------------------------------------------- filters

#: Bits of a filter at most; a larger number of frequent phrases only lets more through.
MOST_BITS = 1 << 29
_SLICE = 1 << 20
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one word more, from those of both."""
    return mix64(phrase * _FIRST + word * _NEXT)


class Filter:
    """One bit for each hash value of its leading bits."""

    def __init__(self, n_bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - n_bits), data

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _as_bits(table: pa.Table) -> pa.Table:
    """The bits of one slice."""
    bits = np.zeros(_SLICE, dtype=np.uint8)
    bits[table.column("place").to_numpy()] = 1
    return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def make_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> Broadcast:
    """A filter of the ``hash`` column, four to eight bits a value up to ``most_bits``; sent to all tasks."""
    spark = hashes.sparkSession
    n_bits = int(min(most_bits, max(_SLICE, 8 * hashes.count()))).bit_length() - 1
    place = F.shiftrightunsigned("hash", 64 - n_bits)
    slices = hashes.select(F.floor(place / _SLICE).alias("slice"), F.pmod(place, F.lit(_SLICE)).alias("place")).distinct()
    data = np.zeros((1 << n_bits) // 8, dtype=np.uint8)
    for at, bits in zip(*(c.to_pylist() for c in slices.groupBy("slice").applyInArrow(_as_bits, "slice long, bits binary").toArrow().columns), strict=True):
        own = data[at * _SLICE // 8 : (at + 1) * _SLICE // 8]
        own[:] = np.frombuffer(bits, dtype=np.uint8)[: len(own)]
    return spark.sparkContext.broadcast(Filter(n_bits, data))


# ------------------------------------------------------------- growing phrases


class Bitmaps:
    """The bitmaps of a shard's words that may be frequent, by word and by block."""

    def __init__(self, row: dict, words: Filter):
        self.words = row["words"].values
        self.hashes = word_hashes(row["lang"].as_py(), self.words.to_pylist())
        n = row["n_entries"].as_py()
        first = _unpacked(row["first"].as_py(), np.int32, len(self.words))
        word = np.repeat(np.arange(len(self.words)), np.diff(np.append(first, n)))
        keep = words.passes(self.hashes)[word]
        self.word = word[keep]
        self.block = np.cumsum(_unpacked(row["blocks"].as_py(), np.int32, n)).astype(np.int64)[keep]
        self.bits = _unpacked(row["bits"].as_py(), np.uint16, n)[keep]
        order = np.argsort(self.block, kind="stable")
        self._word, self._bits = self.word[order], self.bits[order]
        self._first = np.searchsorted(self.block[order], np.arange(self.block.max(initial=0) + 4))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, next word, block, bits): the phrases' bitmaps shifted by one and ANDed with every word's."""
        over = bits >> np.uint16(BLOCK - 1)
        carry = np.flatnonzero(over)
        phrase, block = np.concatenate([phrase, phrase[carry]]), np.concatenate([block, block[carry] + 1])
        bits = np.concatenate([bits << np.uint16(1), over[carry]])
        n = self._first[block + 1] - self._first[block]
        at = np.repeat(np.arange(len(n)), n)
        entry = np.arange(len(at)) + np.repeat(self._first[block] - (np.cumsum(n) - n), n)
        both = bits[at] & self._bits[entry]
        hit = np.flatnonzero(both)
        return phrase[at[hit]], self._word[entry[hit]], block[at[hit]], both[hit]

    def ends(self, phrases: np.ndarray, words: int) -> np.ndarray:
        """The hashes of the last ``words`` words of phrases."""
        out = self.hashes[phrases[:, -words]]
        for k in range(words - 1, 0, -1):
            out = longer_hash(out, self.hashes[phrases[:, -k]])
        return out

    def grow(self, phrases: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, longest: int, filters: list[Filter], batch: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases as rows of word numbers, their popcounts), extended depth-first in batches of entries.

        ``phrases``: those to extend; entries of their bitmaps are ordered by phrase. A
        longer one goes on if its last two words pass the first of ``filters``, its last
        three the second, and so on.
        """
        edges = np.append(np.flatnonzero(np.append(True, phrase[1:] != phrase[:-1])), len(phrase)) if len(phrase) else np.zeros(1, np.int64)
        at = 0
        while at < len(edges) - 1:
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + batch, side="right")) - 1)
            own = slice(edges[at], edges[upto])
            of, word, where, both = self.extend(phrase[own], block[own], bits[own])
            keys, new = np.unique(of * len(self.words) + word, return_inverse=True)
            longer = np.concatenate([phrases[keys // len(self.words)], (keys % len(self.words))[:, None]], axis=1)
            passing = np.ones(len(keys), dtype=bool)
            for words, filter_ in enumerate(filters[: longer.shape[1] - 1], 2):
                passing &= filter_.passes(self.ends(longer, words))
            if not passing.all():
                kept = np.flatnonzero(passing[new])
                new, where, both = (np.cumsum(passing) - 1)[new[kept]], where[kept], both[kept]
                longer = longer[passing]
            if len(longer):
                yield longer, np.bincount(new, weights=np.bitwise_count(both)).astype(np.int64)
                if longer.shape[1] < longest:
                    order = np.argsort(new, kind="stable")
                    yield from self.grow(longer, new[order], where[order], both[order], longest, filters, batch)
            at = upto

    def all(self, longest: int, filters: list[Filter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return self.grow(np.arange(len(self.words))[:, None], self.word, self.block, self.bits, longest, filters)

    def joined(self, phrases: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(phrases[:, k])) for k in range(phrases.shape[1])], " ")


def _each_shard(batches: Iterator[pa.RecordBatch], words: Filter) -> Iterator[tuple[pa.Scalar, Bitmaps]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            yield row["lang"], Bitmaps(row, words)


#: Counts that a task sums up before it sends them on.
_HELD = 1 << 20
#: Hashes are sent as their leading 40 bits; a filter reads fewer.
_CUT = np.uint64(24)


def _pack_hashes(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its hashes, as differences in their order, and their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, keys[order[x:y]], counts[order[x:y]]) for b, x, y in zip(range(buckets), edges[:-1], edges[1:], strict=True) if y > x]
    packed = [[_packed(np.diff(k, prepend=np.uint64(0))) for _, k, _ in rows], [_packed(c) for _, _, c in rows]]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in rows], pa.int32()), pa.array([len(k) for _, k, _ in rows], pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], names=["bucket", "n", "keys", "counts"])


def _hashed(length: int, filters: list[Broadcast], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by hash of the phrases of ``length`` words, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        held, n = [], 0
        for _, maps in _each_shard(batches, known[0]):
            for phrases, count in maps.all(length, known[1:]):
                if phrases.shape[1] == length:
                    held.append((maps.ends(phrases, length) >> _CUT, count))
                    n += len(count)
            if n > _HELD:
                yield _pack_hashes(held, buckets)
                held, n = [], 0
        if n:
            yield _pack_hashes(held, buckets)

    return run


def _sum_hashes(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_unpacked(k.as_py(), np.uint64, n), dtype=np.uint64) for k, n in zip(rows.column("keys"), sizes, strict=True)])
        counts = np.concatenate([_unpacked(c.as_py(), np.int64, n) for c, n in zip(rows.column("counts"), sizes, strict=True)])
        keys, at = np.unique(keys, return_inverse=True)
        frequent = keys[np.bincount(at, weights=counts) >= least]
        return pa.table({"hash": pa.array((frequent << _CUT).view(np.int64))})

    return run


def _pack_phrases(held: list[pa.Table], buckets: int) -> pa.RecordBatch:
    """One row for each bucket: lists of languages, phrases and counts."""
    summed = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum"), ("bucket", "min")])
    summed = summed.take(pc.sort_indices(summed.column("bucket_min")))
    bucket = summed.column("bucket_min").to_numpy()
    edges = np.searchsorted(bucket, np.arange(buckets + 1)).astype(np.int32)
    some = np.flatnonzero(np.diff(edges))
    offsets = pa.array(np.append(edges[some], edges[-1]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, summed.column(c).combine_chunks()) for c in ("lang", "phrase", "f_sum")]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *lists], names=["bucket", "lang", "phrase", "f"])


def _phrases(longest: int, filters: list[Broadcast], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of two words or more that pass the filters, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        held, n = [], 0
        for lang, maps in _each_shard(batches, known[0]):
            for phrases, count in maps.all(longest, known[1:]):
                bucket = (maps.ends(phrases, phrases.shape[1]) % np.uint64(buckets)).astype(np.int64)
                held.append(pa.table({"lang": pa.repeat(lang, len(count)), "phrase": maps.joined(phrases), "f": pa.array(count), "bucket": pa.array(bucket)}))
                n += len(count)
            if n > _HELD:
                yield _pack_phrases(held, buckets)
                held, n = [], 0
        if n:
            yield _pack_phrases(held, buckets)

    return run


def _sum_phrases(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        flat = pa.table({c: rows.column(c).combine_chunks().flatten() for c in ("lang", "phrase", "f")})
        summed = flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])
        return summed.filter(pc.greater_equal(summed.column("f"), least))

    return run


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)
        found = np.array([word_hashes(lang, [word])[0] for lang, word in pairs], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64), pa.int64())], names=["hash"])


# ------------------------------------------------------------- scores


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, shard_bytes: int = 1 << 22, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all words.

    See :func:`mine_phrases`. A task holds one shard, about ``shard_bytes`` of text or one
    piece that is longer, the filters, of at most ``most_bits`` / 8 bytes each, and some
    million counts; after the shuffle, a partition's share of all counts, so
    ``spark.sql.shuffle.partitions`` has to follow the input.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = as_table(texts.mapInArrow(_shards(shard_bytes), _SHARDS), "shards")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("f"))
    totals = cut(shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    words = as_table(each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "words")
    filters = [make_filter(words.mapInArrow(_hash_words, "hash long"), most_bits)]
    maps = shards.drop("counts")
    for length in range(2, min(3, longest) + 1):
        counted = maps.mapInArrow(_hashed(length, filters, buckets), "bucket int, n long, keys binary, counts binary")
        filters.append(make_filter(cut(counted.groupBy("bucket").applyInArrow(_sum_hashes(least), "hash long")), most_bits))
    found = maps.mapInArrow(_phrases(longest, filters, buckets), "bucket int, lang array<string>, phrase array<string>, f array<long>")
    longer = as_table(found.groupBy("bucket").applyInArrow(_sum_phrases(least), "lang string, phrase string, f long"), "phrases")
    return words.unionByName(longer), totals


def mine_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, keep: int = 2000, shard_bytes: int = 1 << 22, most_bits: int = MOST_BITS) -> DataFrame:
    """The ``keep`` best phrases of 2 to ``longest`` words of each language.

    Texts, lower-cased over A-Z, are split at any of .,;:!? and \\x0A-\\x0D into pieces and
    those at spaces and tabs into words. A phrase is a run of words within a piece; f
    counts all its places, overlaps included, and n all words of the language. Phrases
    with a = f >= ``least`` are candidates. Of the cuts of a candidate into two phrases,
    with l and r places, that of the lowest score floor(1000 * a * n / (l * r)) counts,
    ties (of floored scores) to the shortest first part. A candidate goes if a longer one
    that contains it occurs as often.

    Returns lang, rank (from 1), phrase (words joined by a space), a, l, r, n, score, by
    score and a from above, then phrase in byte order. A null language is ``und``. Null and
    empty texts have no words; a language without candidates has no rows. Texts of any
    length are read whole, repeated rows count each time, columns of other names are
    ignored, and an empty table gives an empty result. Counts up to 10**17 are exact.
    """
    counts, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, shard_bytes=shard_bytes, most_bits=most_bits)
    counts = counts.withColumn("words", F.split("phrase", " ", -1))
    candidates = counts.where(F.size("words") > 1)
    part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    size = F.size("words")
    # A longer phrase that contains this one holds one that is longer by a word and occurs no less often.
    inner = candidates.where(size > 2).select("lang", F.col("f").alias("over"), F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    alone = candidates.join(inner, ["lang", "phrase"], "left").where("over IS NULL OR over < f")
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * (CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)))) div (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    scored = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # First within parts of a language, so that no task sorts all its candidates.
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= keep)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= keep)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

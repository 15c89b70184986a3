"""Removal of long repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``span`` bytes over it also starts anywhere else. Texts are
written as blocks of whole documents; suffixes are sorted a bucket at a time, as far as
their first ``span`` bytes, and never all at once:

1. The cover sample. Of every ``v`` positions those in a difference cover of v are
   sampled, so two equal strings have sampled positions at one common distance under v
   from their starts. The sample is sorted bucket by bucket: first by the next
   span - v + 1 bytes, which gives the class of a sampled suffix, and then, in classes of
   several, by its whole context, from v - 1 bytes before it to span bytes after, which
   gives its rank.
2. Long ties. Positions whose rank is shared are equal over the whole context, so all of
   the context goes without sorting a suffix of it. A class of one has no partners.
3. The suffixes that remain lie within v of a sampled position whose class holds several
   ranks. One position stands for all that share a rank, which bounds what hot passages
   cost. Their suffixes are sorted in buckets, by fingerprints of the first span bytes,
   and neighbours that are equal mark each other.

Within a block equal keys are merged before they are sent, so no bucket gets a key more
than once a block. Keys travel without their positions: a block deals its keys to the
buckets in an order that it can find again, and a bucket answers with bits in that order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, as_table, fresh_path, mix64, open_fs, text_slices

#: Perfect difference sets. Every distance modulo v is a difference of two elements.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
#: Keys of a block for a bucket: ``keys`` in dealt order, and bits that mark keys the block has several of.
_SENT = "bucket int, block string, keys binary, many binary"
#: The bucket's answer, as bits in the same order: keys held elsewhere too, and those to go on with.
_REPLY = "bucket int, block string, shared binary, further binary, n_further long"
CLASSES, RANKS, SUFFIXES = 1, 2, 3  # the three sorts
#: Bytes of a key in each: 4 of the class; 4 of the class and 6 of the rank; 7 of the suffix.
KEY_BYTES = {CLASSES: 4, RANKS: 10, SUFFIXES: 7}


def cover_for(span: int) -> int:
    """The largest period whose cover leaves a third of ``span`` to compare."""
    return max(v for v in COVERS if v == 1 or 3 * v <= 2 * span)


# ------------------------------------------------------------------------- blocks


def _write_blocks(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            texts = batch.column("_text").fill_null("")
            for first, last, data, _ in text_slices(texts, block_bytes):
                name = f"{uuid.uuid4().hex}.arrow"
                part = pa.record_batch([batch.column("doc_id").slice(first, last - first), texts.slice(first, last - first)], names=["doc_id", "text"])
                with store.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_pydict({"block": [f"{path}/{name}"], "n_bytes": [len(data)]})

    return run


class Block:
    """The documents of one block: ids, bytes, and where each document starts."""

    def __init__(self, path: str):
        store, inner = open_fs(path)
        with store.open_input_stream(inner) as raw, pa.ipc.open_stream(raw) as reader:
            (part,) = reader
        self.ids = part.column("doc_id")
        ((_, _, self.data, self.offsets),) = text_slices(part.column("text"), 1 << 62)
        self.hasher = Hasher(self.data)

    def sample(self, span: int) -> tuple[np.ndarray, ...]:
        """Sampled positions, context lengths before and after, class key and rank key."""
        v = cover_for(span)
        starts, lengths = self.offsets[:-1], np.diff(self.offsets)
        longest = int(lengths.max(initial=0))
        pattern = (np.arange(0, longest + 1, v)[:, None] + np.array(COVERS[v])).ravel()
        counts = np.where(lengths >= span, np.searchsorted(pattern, lengths - (span - v + 1), side="right"), 0)
        inner = pattern[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        at = inner + np.repeat(starts, counts)
        left = np.minimum(v - 1, inner)
        right = np.minimum(span, np.repeat(lengths, counts) - inner)
        whole = self.hasher.ranges(at - left, at + right)
        rank = mix64(whole + (left * (span + 1) + right).astype(np.uint64))
        return at, left, right, self.hasher.ranges(at, at + (span - v + 1)), rank

    def suffixes(self, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions up to v - 1 before the sampled ones ``at`` that start a string of span bytes, and its keys."""
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        low = np.maximum(self.offsets[doc], at - (cover_for(span) - 1))
        high = np.minimum(at, self.offsets[doc + 1] - span) + 1
        found = np.flatnonzero(_covered(low[high > low], high[high > low], len(self.data)))
        return found, self.hasher.ranges(found, found + span)


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    change = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


# ------------------------------------------------------------------------- buckets


def _order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by ``keys`` (the last leads), and where in it a new key starts."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


class _Merged:
    """Distinct keys: the first place of each, whether there are others, and the key number of every place."""

    def __init__(self, *keys: np.ndarray):
        order, new = _order(*keys)
        self.first = order[new]
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.many = np.bincount(self.number, minlength=len(self.first)) > 1


class _Deal:
    """How a block's keys fall to buckets, by the high bits of a hash."""

    def __init__(self, by: np.ndarray, n_buckets: int):
        bucket = ((by >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(n_buckets + 1))

    def rows(self, block: str, keys: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        """One row for each bucket that gets keys; ``keys`` has a row of bytes per key."""
        own = [(b, self.order[self.cuts[b] : self.cuts[b + 1]]) for b in np.flatnonzero(np.diff(self.cuts))]
        binary = lambda pack: pa.array([pack(places) for _, places in own], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([block] * len(own), pa.string()), binary(lambda places: keys[places].tobytes()), binary(lambda places: np.packbits(many[places]).tobytes())], names=["bucket", "block", "keys", "many"])

    def answers(self, replies: pa.Table, column: str) -> np.ndarray:
        """A bucket's bits, put back at their keys."""
        out = np.zeros(len(self.order), dtype=bool)
        for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist(), strict=True):
            places = self.order[self.cuts[bucket] : self.cuts[bucket + 1]]
            out[places] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(places)).astype(bool)
        return out


def _low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return values.view(np.uint8).reshape(-1, 8)[:, :n]


def _number(rows: np.ndarray) -> np.ndarray:
    """Bytes of each row as one number."""
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(np.uint64).ravel()


def rank_sample(kind: np.ndarray, rank: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ranks are shared; and which places stand for their rank in a class of several."""
    order, new = _order(rank, kind)
    number = np.cumsum(new) - 1
    shared = np.bincount(number, minlength=int(new.sum())) > 1
    shared |= np.bincount(number, weights=many[order], minlength=len(shared)) > 0
    heads = order[new]
    fresh = np.ones(len(heads), dtype=bool)
    fresh[1:] = kind[heads][1:] != kind[heads][:-1]
    mixed = (np.bincount(np.cumsum(fresh) - 1) > 1)[np.cumsum(fresh) - 1] if len(heads) else fresh
    is_shared, stands = np.zeros(len(kind), dtype=bool), np.zeros(len(kind), dtype=bool)
    is_shared[order] = shared[number]
    stands[heads[mixed]] = True
    return is_shared, stands


def _sort_bucket(stage: int):
    """Sorts one bucket and answers each block."""

    def run(table: pa.Table) -> pa.Table:
        width = KEY_BYTES[stage]
        held = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, width) for x in table.column("keys")]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)) for x, h in zip(table.column("many"), held, strict=True)]).astype(bool)
        ends = np.cumsum([len(h) for h in held])
        keys = np.concatenate(held)
        if stage == RANKS:
            shared, further = rank_sample(_number(keys[:, :4]), _number(keys[:, 4:]), many)
        else:
            merged = _Merged(_number(keys))
            shared = (merged.many | (np.bincount(merged.number, weights=many) > 0))[merged.number]
            further = shared if stage == CLASSES else np.zeros(len(keys), dtype=bool)
        cut = lambda bits: [bits[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        binary = lambda parts: pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
        return pa.table({"bucket": table.column("bucket").cast(pa.int32()), "block": table.column("block").cast(pa.string()), "shared": binary(cut(shared)), "further": binary(cut(further)), "n_further": pa.array([int(p.sum()) for p in cut(further)], pa.int64())})

    return run


# --------------------------------------------------------------------- block passes


class _Run:
    """A block, and what the buckets have answered so far; each sort builds on the one before."""

    def __init__(self, path: str, span: int, n_buckets: dict[int, int], replies: pa.Table | None = None):
        self.path, self.span, self.n_buckets, self.replies = path, span, n_buckets, replies
        self.block = Block(path)
        self.at, self.left, self.right, self.kind, self.rank = self.block.sample(span)

    def _answers(self, stage: int, deal: _Deal, column: str) -> np.ndarray:
        return deal.answers(self.replies.filter(pc.equal(self.replies.column("stage"), stage)), column)

    def classes(self) -> tuple[_Merged, _Deal]:
        merged = _Merged(self.kind)
        return merged, _Deal(self.kind[merged.first], self.n_buckets[CLASSES])

    def ranks(self) -> tuple[np.ndarray, _Merged, _Deal]:
        """Sampled places whose class has others, merged by rank."""
        merged, deal = self.classes()
        places = np.flatnonzero((self._answers(CLASSES, deal, "shared") | merged.many)[merged.number])
        merged = _Merged(self.rank[places], self.kind[places])
        return places, merged, _Deal(self.kind[places[merged.first]], self.n_buckets[RANKS])

    def verdicts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places with a shared rank, and those whose suffixes are to be sorted."""
        places, merged, deal = self.ranks()
        shared = (self._answers(RANKS, deal, "shared") | merged.many)[merged.number]
        return places[shared], places[merged.first[self._answers(RANKS, deal, "further")]]

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Merged, _Deal]:
        found, keys = self.block.suffixes(np.sort(self.at[chosen]), self.span)
        merged = _Merged(keys)
        return found, keys, merged, _Deal(keys[merged.first], self.n_buckets[SUFFIXES])

    def sent(self, stage: int) -> pa.RecordBatch:
        if stage == CLASSES:
            merged, deal = self.classes()
            keys = _low_bytes(self.kind[merged.first], 4)
        elif stage == RANKS:
            places, merged, deal = self.ranks()
            heads = places[merged.first]
            keys = np.hstack([_low_bytes(self.kind[heads], 4), _low_bytes(self.rank[heads], 6)])
        else:
            _, all_keys, merged, deal = self.suffixes(self.verdicts()[1])
            keys = _low_bytes(all_keys[merged.first], 7)
        return deal.rows(self.path, keys, merged.many)

    def gone(self) -> np.ndarray:
        """Which bytes of the block go."""
        shared, chosen = self.verdicts()
        shared = shared[self.left[shared] + self.right[shared] >= self.span]
        found, _, merged, deal = self.suffixes(chosen)
        equal = found[(self._answers(SUFFIXES, deal, "shared") | merged.many)[merged.number]]
        starts, ends = self.at[shared] - self.left[shared], self.at[shared] + self.right[shared]
        return _covered(np.concatenate((starts, equal)), np.concatenate((ends, equal + self.span)), len(self.block.data))


def _send_classes(span: int, n_buckets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("block").to_pylist():
                yield _Run(path, span, n_buckets).sent(CLASSES)

    return run


def _send(stage: int, span: int, n_buckets: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_Run(table.column("block")[0].as_py(), span, n_buckets, table).sent(stage)])

    return run


def _cut_block(span: int, n_buckets: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        done = _Run(table.column("block")[0].as_py(), span, n_buckets, table)
        block, gone = done.block, done.gone()
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[block.offsets] = True
        before = np.concatenate(([False], gone[:-1]))
        after = np.concatenate((gone[1:], [False]))
        start = np.flatnonzero(gone & (~before | edge[:-1]))
        end = np.flatnonzero(gone & (~after | edge[1:])) + 1
        owner = np.searchsorted(block.offsets, start, side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(block.ids) + 1))
        own = np.repeat(block.offsets[:-1], np.diff(bounds))
        spans = pa.StructArray.from_arrays([pa.array(start - own, pa.int64()), pa.array(end - own, pa.int64())], names=["start", "end"])
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
        return pa.table({"doc_id": block.ids, "n_bytes": pa.array(np.diff(block.offsets), pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 200, block_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, blocks_per_task: int = 4) -> DataFrame:
    """Removes every byte covered by a ``span``-byte string that also starts anywhere else.

    Returns one row per input row: doc_id, n_bytes, spans (removed byte ranges, maximal,
    as array<struct<start, end>>) and kept (the remaining bytes, concatenated; they need
    not be valid UTF-8). Strings are judged on the input, overlaps count, and no string
    crosses documents. Equality rests on fingerprints: of contexts 48 bits within a class,
    of suffixes 56 bits within a bucket.

    A null text counts as empty; texts under ``span`` bytes keep all. Repeated rows are
    documents of their own, and so copies of each other. A null id is kept. Columns of
    other names are ignored. An empty table gives an empty result. Texts are whole: a
    text above ``block_bytes`` makes a block of its own. Blocks go to the shared folder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    blocks = as_table(rows.mapInArrow(_write_blocks(fresh_path(docs.sparkSession, "blocks"), block_bytes), "block string, n_bytes long"), "block-list")
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    v = cover_for(span)
    share = len(COVERS[v]) / v
    sized = lambda keys, stage: int(keys * KEY_BYTES[stage] / bucket_bytes) + 1
    further = lambda replies: replies.agg(F.coalesce(F.sum("n_further"), F.lit(0))).first()[0]
    # Answers are small beside the work that they start, so partitions are counted by blocks and buckets, not by bytes.
    sort = lambda sent, stage: sent.repartition(n_buckets[stage], "bucket").groupBy("bucket").applyInArrow(_sort_bucket(stage), _REPLY).withColumn("stage", F.lit(stage))
    by_block = lambda replies: replies.repartition(-(-n_blocks // blocks_per_task) or 1, "block").groupBy("block")

    n_buckets = {CLASSES: sized(total * share, CLASSES)}
    spread = blocks.select("block").repartition(n_blocks or 1, "block")
    classes = as_table(sort(spread.mapInArrow(_send_classes(span, n_buckets), _SENT), CLASSES).where("n_further > 0"), "classes")
    # A row of its own keeps blocks to which no bucket has an answer.
    here = blocks.select(F.lit(0).alias("bucket"), "block", F.lit(b"").alias("shared"), F.lit(b"").alias("further"), F.lit(0).cast("long").alias("n_further"), F.lit(0).alias("stage"))
    replies = here.unionByName(classes)

    n_buckets = n_buckets | {RANKS: sized(further(classes), RANKS)}
    ranks = as_table(sort(by_block(replies).applyInArrow(_send(RANKS, span, n_buckets), _SENT), RANKS), "ranks")
    replies = replies.unionByName(ranks)

    n_buckets = n_buckets | {SUFFIXES: sized(further(ranks) / share, SUFFIXES)}
    suffixes = sort(by_block(replies).applyInArrow(_send(SUFFIXES, span, n_buckets), _SENT), SUFFIXES)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return by_block(replies.unionByName(suffixes)).applyInArrow(_cut_block(span, n_buckets), schema)

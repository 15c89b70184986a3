"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet in the middle: there is a value that one reaches
by two flips at most and the other by one. Flips change the parity of the number of set
bits, so two fingerprints three bits (or one) apart are of different parity, and two bits
apart of the same. Hence

* an odd fingerprint emits its 64 variants by one flip;
* an even one emits itself, its variants by one flip, and those by two flips within one
  half of the bits (of three differing bits two lie in the same half; the odd partner
  flips the third).

Variants meet in buckets of equal values on a few prefix bits. A fingerprint is sent
once to every bucket that its ball reaches, and the variants are made there, so what is
shuffled is some dozens of rows a fingerprint and not a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, cut, heavy_light_join, text_slices, word_ranges

#: Most differing bits of two linked fingerprints; the variants below are those of this radius.
RADIUS = 3
HALVES = (range(0, 32), range(32, 64))


def _flips(bits: list[int]) -> np.ndarray:
    """Single flips among ``bits``."""
    return np.array([1 << b for b in bits], dtype=np.uint64)


def _double_flips(bits: list[int]) -> np.ndarray:
    """Pairs of flips among ``bits`` that lie in one half."""
    return np.array([1 << a | 1 << b for a in bits for b in bits if a < b and (a < 32) == (b < 32)], dtype=np.uint64)


_ALL = [*range(64)]
_ODD = _flips(_ALL)
#: The last of these, by two flips, do not link among themselves.
_EVEN = [np.concatenate([np.zeros(1, np.uint64), _flips(_ALL)]), _double_flips(_ALL)]


# ------------------------------------------------------------- fingerprints


def _shingle_ranges(word: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word) of the shingles of texts of ``count`` words from word ``first`` on."""
    n = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return start, np.minimum(start + width, (first + count)[text]) - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, chunk: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each text in the buffer: bits set in over half of its shingles' hashes."""
    start, end, text = word_ranges(LOWER[data], offsets)
    texts = len(offsets) - 1
    count = np.bincount(text, minlength=texts).astype(np.int64)
    # One space between words: a word's bytes and the byte behind it stay, the latter as a space.
    keep = np.zeros(len(data) + 1, dtype=bool)
    mark = np.zeros(len(data) + 2, dtype=np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    keep[:] = np.cumsum(mark[:-1]) > 0
    joined = np.where(keep[:-1], LOWER[data], np.uint8(0x20))
    keep[end] = True
    place = np.cumsum(keep) - 1
    buffer = np.append(joined, np.uint8(0x20))[keep].tobytes()
    begin, finish = place[start], place[start] + (end - start)
    first, last = _shingle_ranges(text, np.cumsum(count) - count, count, width)
    shingles = np.maximum(count - width + 1, (count > 0).astype(np.int64))
    own = np.repeat(np.arange(texts), shingles)
    ones = np.zeros((texts, 64), dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), chunk):
        a, b = begin[first[at : at + chunk]].tolist(), finish[last[at : at + chunk]].tolist()
        hashes = np.frombuffer(b"".join([digest(buffer[x:y], 42) for x, y in zip(a, b, strict=True)]), dtype=np.uint8).reshape(-1, 8)
        bits, part = np.unpackbits(hashes, axis=1), own[at : at + chunk]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ones[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                found = fingerprints(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


# ------------------------------------------------------------- ball hashing


def prefix_bits(share: list[float], variants: float, bucket_variants: int) -> list[int]:
    """As many of the bits that best halve the fingerprints, alike from both halves, as make buckets small enough."""
    n = min(60, max(0, int(np.ceil(np.log2(max(1.0, variants / bucket_variants))))))
    near = [sorted(half, key=lambda b: (abs(share[b] - 0.5), b)) for half in HALVES]
    return sorted(near[0][: (n + 1) // 2] + near[1][: n // 2])


def reached(fp: Column, bits: list[int]) -> Column:
    """The buckets that the ball around ``fp`` reaches: its prefix and the flips in it."""
    signed = lambda masks: F.array(*[F.lit(int(m)).cast("long") for m in np.concatenate([np.zeros(1, np.uint64), *masks]).view(np.int64)])
    prefix = fp.bitwiseAND(F.lit(int(np.bitwise_or.reduce(_flips(bits), initial=np.uint64(0)).view(np.int64))).cast("long"))
    odd, even = signed([_flips(bits)]), signed([_flips(bits), _double_flips(bits)])
    return F.transform(F.when(F.bit_count(fp) % 2 == 1, odd).otherwise(even), lambda d: prefix.bitwiseXOR(d))


def _variants(fps: np.ndarray, bucket: np.uint64, mask: np.uint64, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, fingerprint) of the variants by ``flips`` that fall into the bucket."""
    away, of = (fps & mask) ^ bucket, flips & mask
    out = []
    for d in np.unique(away):
        own, by = fps[away == d], flips[of == d]
        out.append(((own[:, None] ^ by).ravel(), np.repeat(own, len(by))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def bucket_links(fps: np.ndarray, bucket: np.uint64, mask: np.uint64, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between fingerprints whose variants collide in the bucket: a star for each variant.

    Fingerprints that reach one variant by at most one flip are within three bits of all
    others there, so one of them is the star's centre; a variant that all reach by two
    flips links none, as two of those are linked by another variant if at all. A bucket
    of more than ``most`` variants is cut by one bit more.
    """
    odd = np.bitwise_count(fps) % 2 == 1
    inside = bin(int(mask)).count("1")
    if inside < 62 and len(fps) * (len(_ODD) + sum(map(len, _EVEN))) // 2 > most << inside.bit_length() and len(fps) > 2:
        half = HALVES[0] if sum(int(mask) >> b & 1 for b in HALVES[0]) <= inside / 2 else HALVES[1]
        free = [b for b in half if not int(mask) >> b & 1]
        share = [(fps >> np.uint64(b) & np.uint64(1)).mean() for b in free]
        bit = np.uint64(1 << min(zip(share, free, strict=True), key=lambda x: abs(x[0] - 0.5))[1])
        for value in (np.uint64(0), bit):
            away = np.bitwise_count((fps & (mask | bit)) ^ (bucket | value))
            own = fps[away <= np.where(odd, 1, 2)]
            if len(own) > 1:
                yield from bucket_links(own, bucket | value, mask | bit, most)
        return
    near = [_variants(fps[odd], bucket, mask, _ODD), _variants(fps[~odd], bucket, mask, _EVEN[0])]
    far = _variants(fps[~odd], bucket, mask, _EVEN[1])
    n_near = sum(len(v) for v, _ in near)
    variant, of = (np.concatenate(x) for x in zip(*near, far, strict=True))
    ordered = np.sort(variant)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, variant)
    meet = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == variant)
    meet = meet[np.argsort(at[meet], kind="stable")]  # those by one flip at most stay before the others
    group = at[meet]
    opens = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    centre = np.repeat(meet[opens], np.diff(np.append(opens, len(meet))))
    u, v = of[centre], of[meet]
    linked = (centre < n_near) & (u != v) & (np.bitwise_count(u ^ v) <= RADIUS)
    yield u[linked], v[linked]


def _bucket(mask: int, most: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        bucket = table.column("bucket").to_numpy()[:1].view(np.uint64)[0]
        found = [np.sort(np.stack([u.view(np.int64), v.view(np.int64)]), axis=0) for u, v in bucket_links(fps, bucket, np.uint64(mask), most)]
        pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.table({"u": pa.array(pairs[0]), "v": pa.array(pairs[1])})

    return run


def ball_links(distinct: DataFrame, bucket_variants: int = 1 << 20) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` within three bits of each other.

    Any two within three bits are joined by a path of links. A task makes about
    ``bucket_variants`` variants at a time; the number of buckets follows the number of
    fingerprints.
    """
    shares = distinct.agg(F.count("*").alias("n"), *[F.avg(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in _ALL]).first()
    mean_ball = (len(_ODD) + sum(map(len, _EVEN))) / 2
    bits = prefix_bits([shares[f"b{b}"] or 0.0 for b in _ALL], shares["n"] * mean_ball, bucket_variants)
    mask = int(np.bitwise_or.reduce(_flips(bits), initial=np.uint64(0)))
    sent = distinct.select("fp", F.explode(reached(F.col("fp"), bits)).alias("bucket"))
    return sent.groupBy("bucket").applyInArrow(_bucket(mask, 4 * bucket_variants), "u long, v long").distinct()


def near_duplicate_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The SimHash fingerprint of each text and its class of linked fingerprints.

    Words are runs of bytes other than space and \\x09-\\x0D, after lower-casing A-Z;
    shingles are ``width`` words joined by a space, repeats included, and a text of fewer
    words is one shingle. A bit of the 64 is set if over half of the shingles' XXH64
    (seed 42) have it. Fingerprints with at most three differing bits link.

    Returns one row a row of ``docs``: the id, fp (long), fingerprint (16 hex digits) and
    component_id, the smallest id of the class. Null and empty texts, and texts without a
    word, have fingerprint zero and link like any other. Rows of one id are decided by
    their own texts. A null id is passed over when the smallest is taken; a class of
    none but null ids has a null component. Texts of any length are read whole. Columns
    of other names are ignored. An empty table gives an empty result.

    Equal fingerprints are one node. Hot ones are met by a broadcast of fewer than
    20,000 rows, so no task gathers their documents.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint(width), f"doc_id {id_type}, fp long")
    rows = cut(rows)
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    labels = cut(connected_components(cut(ball_links(distinct))).select(F.col("node").alias("fp"), "component"))
    nodes = cut(labels.join(distinct, "fp"))
    least = nodes.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("m"))
    classed = heavy_light_join(nodes.select("fp", "component"), least, "component", "m", nodes.count())
    found = distinct.join(classed.select("fp", "least"), "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    joined = heavy_light_join(rows, cut(found), "fp", "n", rows.count())
    return joined.select(F.col("doc_id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

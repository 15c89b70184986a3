"""Document quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its bytes, words and lines. The weights
maximise the likelihood that of a pair (label 1, label 0) the first wins:
log sigmoid(w . (x_good - x_bad)). A quantile of the training scores, at the share of
label 0, becomes the threshold, and scores are mapped to 0..1 so that it sits at
``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import LOWER, fold_of, hash_words, text_slices, word_ranges

#: Byte classes; the features count each pair of neighbours.
_KINDS = [b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"|", b"%", b"#", b"$", b"&", b"*", bytes(range(128, 256))]
_CLASS = np.full(256, 15, dtype=np.int64)
for _k, _chars in enumerate(_KINDS):
    _CLASS[list(_chars)] = _k
N_FEATURES = 256 + 8
#: Rows of a batch that are read and sent on at a time, and bytes of text whose words are held at once.
ROWS, BYTES = 1024, 1 << 18


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that neither side of a worker holds the features or results of a whole batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of features per text; a null or empty text has zeros throughout."""
    out = np.zeros((len(column), N_FEATURES), dtype=np.float32)
    for first, last, data, offsets in text_slices(column, BYTES):
        kinds = _CLASS[data]
        start, end, owner = word_ranges(data, offsets)
        hashes = hash_words(LOWER[data], start, end)
        words = np.searchsorted(owner, np.arange(last - first + 1))
        breaks = np.flatnonzero(data == 10)
        for k in range(last - first):
            a, b = offsets[k], offsets[k + 1]
            if a == b:
                continue
            row, own = out[first + k], kinds[a:b]
            row[:256] = np.sqrt(np.bincount(own[:-1] * 16 + own[1:], minlength=256) / (b - a))
            w = slice(words[k], words[k + 1])
            n_words = max(1, w.stop - w.start)
            lengths = (end[w] - start[w]).astype(np.float64)
            lines = np.concatenate(([a - 1], breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)], [b]))
            spans = np.diff(lines) - 1
            keys = data[a:b].tobytes().split(b"\n")
            row[256:] = (
                np.log1p(b - a),
                lengths.sum() / n_words,
                lengths.std() if len(lengths) else 0,
                len(np.unique(hashes[w])) / n_words,
                len(set(keys)) / len(keys),
                np.log1p(spans.mean()),
                np.log1p(spans.max()),
                np.isin(data[start[w]], np.frombuffer(_KINDS[3], dtype=np.uint8)).sum() / n_words,
            )
    return out


@dataclass(frozen=True)
class Ranker:
    """A fitted ranking; without pairs to learn from ``weights`` is None and every score is ``prior``."""

    mean: np.ndarray | None
    weights: np.ndarray | None
    threshold: float
    cut: float
    prior: float

    def margins(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        margin = self.margins(features) - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin + np.log(self.cut / (1 - self.cut)), -30, 30)))


def fit_ranker(features: np.ndarray, labels: np.ndarray, cut: float, pairs: int = 20000, penalty: float = 1.0, steps: int = 25) -> Ranker:
    """Newton on the logistic loss of feature differences over ``pairs`` preference pairs.

    With fewer possible pairs all are used; every row of either class is in some pair.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranker(None, None, 0.0, cut, float(labels.mean()) if len(labels) else 1.0)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = (features - mean) / scale
    draw = np.random.default_rng(7)
    n = max(pairs, len(good), len(bad)) if len(good) * len(bad) > pairs else len(good) * len(bad)
    left = np.resize(draw.permutation(good), n)
    right = np.resize(draw.permutation(bad), n)[draw.permutation(n)]
    diff = x[left]
    diff -= x[right]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        slope = diff.T @ p - penalty * w
        curve = np.zeros((len(w), len(w)))
        for rows in np.array_split(np.arange(n), n // 2048 + 1):  # keeps the weighted copy small
            curve += (diff[rows] * (p[rows] * (1 - p[rows]))[:, None].astype(np.float32)).T @ diff[rows]
        curve[np.diag_indices_from(curve)] += penalty
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    scores = x @ w
    return Ranker(mean.astype(np.float32), (w / scale).astype(np.float64), float(np.quantile(scores, len(bad) / len(labels))), cut, 1.0)


def learn_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out_fold: int = 2, cut: float = 0.7, max_rows: int = 20000) -> Ranker:
    """Fits on labelled rows outside ``held_out_fold`` of crc32(id) modulo ``folds``.

    Documented bound: the weights come from at most ``max_rows`` label rows, those with the
    smallest hash of the id; the threshold is a quantile over all label rows, read from a
    scoring pass. Texts are used whole. Rows with a null id, a label other than 0 and 1, or
    no document are left out; several labels of one document all count.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold_of(F.col(id_col), folds) != held_out_fold)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = text_features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array([r.tobytes() for r in found], pa.binary())], names=["_id", "_label", "_features"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(run, f"_id {kind}, _label int, _features binary").collect(), key=lambda r: (str(r[0]), r[1], bytes(r[2])))
    features = np.frombuffer(b"".join(bytes(r[2]) for r in got), dtype=np.float32).reshape(-1, N_FEATURES)
    ranker = fit_ranker(features, np.array([r[1] for r in got], dtype=np.int64), cut)
    if ranker.weights is None:
        return ranker

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(ranker.margins(text_features(batch.column("_text"))), pa.float64())], names=["_id", "_margin"])

    scored = texts.where("_id IS NOT NULL").mapInArrow(margins, f"_id {kind}, _margin double").join(known, "_id")
    share = scored.agg(F.avg(1 - F.col("_label")).alias("bad"), F.percentile_approx("_margin", F.array(*[F.lit(k / 1000) for k in range(1001)]), F.lit(100_000)).alias("at")).first()
    return replace(ranker, threshold=float(np.interp(share.bad * 1000, np.arange(1001), share["at"])))


def score_quality(docs: DataFrame, ranker: Ranker, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Scores every row: doc_id, score (0 to 1), predicted (1 if the score is at least the cut), carried.

    Null and empty texts are scored like any other, from features that are all zero.
    Repeated rows get equal scores; a null id is kept. Columns of other names are
    ignored. Texts are read whole; nothing is shuffled.
    """
    kept = F.struct(F.col(id_col).alias("doc_id"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else [])).alias("_row")
    # A text that is carried goes to the workers once.
    inside = list(carry).index(text_col) if text_col in carry and docs.schema[text_col].dataType == StringType() else None
    rows = docs.select(kept, *([F.col(text_col).cast("string").alias("_text")] if inside is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = batch.column("_text") if inside is None else batch.column("_row").field("carried").field(inside)
            score = ranker.scores(text_features(texts))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score, pa.float64())], names=["_row", "score"])

    found = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, score double")
    return found.select("_row.doc_id", "score", (F.col("score") >= ranker.cut).cast("int").alias("predicted"), *(["_row.carried"] if carry else []))

"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams, normalised to length one. Each
language has several centroids, found by spherical k-means over its training vectors,
and a text takes the language of the centroid of highest cosine. A text further from
that centroid than nearly all of the centroid's own training texts is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, fold_of, text_slices

DIMS = 4096
#: Bytes as n-grams see them: A-Z lower-cased, other ASCII but letters as a space.
_SEEN = LOWER.astype(np.uint32)
_SEEN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def count_ngrams(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte 1-, 2- and 3-grams, a row of DIMS per text (null as empty)."""
    out = np.zeros((len(column), DIMS), dtype=np.float32)
    for first, last, data, offsets in text_slices(column):
        one = _SEEN[data]
        two = (one[:-1] * np.uint32(257) + one[1:]) * np.uint32(2654435761)
        three = ((one[:-2] * np.uint32(66049) + one[1:-1] * np.uint32(257) + one[2:] + np.uint32(7)) * np.uint32(2246822519)) if len(one) > 2 else one[:0]
        two, three = two >> np.uint32(20), three >> np.uint32(20)
        for k in range(last - first):
            a, b = int(offsets[k]), int(offsets[k + 1])
            if b > a:
                grams = np.concatenate((one[a:b], two[a : b - 1], three[a : max(a, b - 2)]))
                out[first + k] = np.bincount(grams, minlength=DIMS)
                out[first + k, 32] = 0  # how often spaces stand says nothing
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, each row of length one (or zero)."""
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, clusters: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, and drops empty clusters."""
    centres = rows.mean(axis=0, keepdims=True)
    for _ in range(min(clusters, len(rows)) - 1):
        centres = np.vstack((centres, rows[(rows @ centres.T).max(axis=1).argmin()]))
    for _ in range(steps):
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == k].mean(axis=0) for k in range(len(centres)) if (own == k).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and rejection of each text."""
        letters = np.array([_has_letter(t) for t in column.to_pylist()], dtype=bool)
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column)), np.ones(len(column), dtype=bool)
        cosine = weigh(count_ngrams(column), self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score, ~letters | (score < self.floors[best])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    held_out_fold: int = 0,
    clusters: int = 4,
    rows_per_lang: int = 1500,
    reject_share: float = 0.005,
) -> LanguageModel:
    """Learns from rows with text, language and id outside ``held_out_fold`` of crc32(id) mod ``folds``.

    Document frequencies and the distances for rejection count every such row. Centroids
    are clustered within each language, a task each, over at most ``rows_per_lang`` of its
    distinct rows (documented bound), chosen by hash. The driver gets the frequencies
    (DIMS rows), the centroids (``clusters`` a language) and a histogram of cosines for each.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != held_out_fold))
    known = known.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                counts = count_ngrams(batch.slice(first, 512).column("_text"))
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMS), pa.int32()), pa.array(np.concatenate(([n], total)), pa.int64())], names=["dim", "n"])

    held = dict(known.select("_text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())
    n_docs = held.get(-1, 0)
    idf = np.log((1 + n_docs) / (1 + np.array([held.get(d, 0) for d in range(DIMS)], dtype=np.float64))).astype(np.float32) + 0.05

    # Rows under a hash threshold, about three times as many as are used, are all that a language gathers.
    seed = F.xxhash64("_id", "_text")
    shares = known.groupBy("_lang").agg(F.approx_count_distinct(seed).alias("_n")).select("_lang", (F.lit(3.0 * rows_per_lang) / F.greatest("_n", F.lit(1))).alias("_share"))
    few = known.join(F.broadcast(shares), "_lang").where(F.pmod(seed, F.lit(1_000_000_007)) < F.col("_share") * 1_000_000_007).select("_lang", "_id", "_text").dropDuplicates()
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(seed, "_id", "_text"))
    chosen = few.withColumn("_place", place).where(F.col("_place") <= rows_per_lang)

    def centroids(table: pa.Table) -> pa.Table:
        rows = weigh(count_ngrams(table.column("_text").combine_chunks()), idf)
        found = cluster(rows[np.lexsort(rows[:, :8].T)], clusters)
        return pa.table({"lang": pa.array([table.column("_lang")[0].as_py()] * len(found), pa.string()), "centroid": pa.array([c.astype(np.float32).tobytes() for c in found], pa.binary())})

    got = sorted(chosen.select("_lang", "_text").groupBy("_lang").applyInArrow(centroids, "lang string, centroid binary").collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    matrix = np.frombuffer(b"".join(bytes(r.centroid) for r in got), dtype=np.float32).reshape(-1, DIMS)
    langs = [r.lang for r in got]
    return LanguageModel(idf, langs, matrix, _floors(known, idf, langs, matrix, reject_share))


def _floors(known: DataFrame, idf: np.ndarray, langs: list[str], matrix: np.ndarray, reject_share: float, bins: int = 2000) -> np.ndarray:
    """The cosine that ``reject_share`` of a centroid's own training texts stay under, from all of them, to 1 / ``bins``."""
    if not langs:
        return np.zeros(0)
    places = {lang: np.array([k for k, own in enumerate(langs) if own == lang]) for lang in set(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * bins, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                cosine = weigh(count_ngrams(part.column("_text")), idf) @ matrix.T
                of = np.array(part.column("_lang").to_pylist())
                for lang in set(of) & set(places):
                    own = cosine[of == lang][:, places[lang]]
                    at = np.clip(own.max(axis=1) * bins, 0, bins - 1).astype(np.int64)
                    total += np.bincount(places[lang][own.argmax(axis=1)] * bins + at, minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["cell", "n"])

    counts = np.zeros(len(langs) * bins, dtype=np.int64)
    for r in known.select("_lang", "_text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    counts = counts.reshape(-1, bins)
    under = np.cumsum(counts, axis=1) < np.maximum(counts.sum(axis=1, keepdims=True) * reject_share, 1e-9)
    return np.where(counts.any(axis=1), under.sum(axis=1) / bins, 0.0)


def identify_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Predicts every row: doc_id, lang_pred, score (cosine, 0 to 1), rejected, carried.

    ``und`` with score 0 for a null text, one without a letter, and for every text if
    nothing was learned. Rejected texts keep their nearest language; callers choose what
    to do with them. A null id and repeated rows are kept. Columns of other names are
    ignored. Whole texts are read; nothing is shuffled.
    """
    kept = F.struct(F.col(id_col).alias("doc_id"), *([F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else [])).alias("_row")
    rows = docs.select(kept, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lang, score, rejected = model.predict(part.column("_text"))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["_row", "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return found.select("_row.doc_id", "lang_pred", "score", "rejected", *(["_row.carried"] if carry else []))

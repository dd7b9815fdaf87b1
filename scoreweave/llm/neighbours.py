"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its byte pairs, hashed to a fixed number of buckets, and a few counts (words,
repeated words, signs, lines). Square-rooted counts with inverse document frequencies, counted over
all documents, are projected on the leading directions of labelled texts, so documents are vectors of fixed length. The labelled
vectors go to all tasks; each document's cosine with every one of them is computed in blocks, and
its nearest neighbours vote with their similarity as weight.

The labelled texts are a bounded sample: at most `most_rows` labelled ids, those with the smallest
hash, outside the held-out fold. Every document is scored.

Defined cases: null or empty text has no direction and gets the label-1 share of the sample; so does
every text when the sample is empty (share 0.5); null labels teach nothing; a null doc_id is held
out with the rest of fold 0; repeated rows are scored each; ties in similarity go to the neighbour
that comes first in the sample; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod
from .encode import in_slices
from .words import LINES, SPACED, bytes_of, mix, per_row, repeated, shingles, spans

BUCKETS = 1000
COUNTS = 6
_PAIR = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


def terms(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of square-rooted term counts a text, of length one (zero for empty texts)."""
    n = len(starts) - 1
    out = np.zeros((n, BUCKETS + COUNTS), np.float32)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), np.diff(starts))
    within = row[1:] == row[:-1]
    at = row[:-1] * BUCKETS + _PAIR[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    out[:, :BUCKETS] = np.bincount(at[within], minlength=n * BUCKETS).reshape(n, BUCKETS)
    words = spans(raw, starts, SPACED)
    lines = spans(raw, starts, LINES, empty=True)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    with np.errstate(over="ignore"):
        h, first = shingles(words, 3)
        twice, _ = repeated(mix(h + words.row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    ascii_sign = (raw > 32) & (raw < 127) & ~((raw >= 48) & (raw < 58)) & ~((raw | 32) >= 97) | (raw > 122) & (raw < 127)
    counts = (words.row, words.row[again], words.row[first[twice]], row[ascii_sign], lines.row, row[raw >= 128])
    for i, rows in enumerate(counts):
        out[:, BUCKETS + i] = 8 * per_row(rows, n)
    np.sqrt(out, out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Space:
    """Projection with weights folded in, and the labelled vectors of length one with their labels."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, size: int, idf: np.ndarray) -> Space:
        weighted = x * idf
        _, directions = np.linalg.eigh(weighted.T @ weighted)
        project = (idf[:, None] * directions[:, ::-1][:, :size]).astype(np.float32)
        return cls(project, _unit(x @ project), labels.astype(np.float32), float(labels.mean()))

    def score(self, x: np.ndarray, k: int, power: float, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.share)
        for i in range(0, len(x), block):
            v = _unit(x[i : i + block] @ self.project)
            cosine = v @ self.vectors.T
            near = np.argpartition(-cosine, min(k, cosine.shape[1]) - 1, axis=1)[:,
                :k] if cosine.shape[1] > k else np.broadcast_to(np.arange(cosine.shape[1]), (len(v), cosine.shape[1]))
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
            total = weight.sum(1)
            some = total > 0
            out[i : i + block][some] = ((weight * self.labels[near]).sum(1) / np.where(some, total, 1))[some]
        return np.clip(out, 0, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weights of the terms by the number of documents that have them, over all documents."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, np.zeros(BUCKETS + COUNTS, np.int64)
        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                total += (terms(*bytes_of(batch.column("text"))) > 0).sum(0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, n))], ["term", "n"])

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS + COUNTS + 1)
    n[sums["term"]] = sums["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def fit(docs: DataFrame, labels: DataFrame, held_out_of, most_rows: int = 6000, size: int = 64) -> Space | None:
    """The space of at most most_rows labelled texts outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    sample = known.where(~held_out_of(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                x = terms(*bytes_of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"),
                    pa.array([v.astype("<f2").tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    vectors = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary")
    vectors = vectors.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(most_rows)  # also where an id has many rows
    rows = vectors.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f2").reshape(rows.num_rows, -1).astype(np.float32)
    return Space.fit(x, rows.column("quality").to_numpy() == 1, size, inverse_frequencies(docs))


def scores(docs: DataFrame, labels: DataFrame, held_out_of, k: int = 15, power: float = 4.0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out_of))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                x = terms(*bytes_of(batch.column("text")))
                score = np.full(len(x), 0.5) if sent.value is None else sent.value.score(x, k, power)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                    pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fold_is(n: int, fold: int):
    return lambda col: crc32_mod(col, n) == fold

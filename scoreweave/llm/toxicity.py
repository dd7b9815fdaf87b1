"""Toxicity by a counterfactual-regularised classifier.

A text's features are the words and pairs of neighbouring words in it (present or not) out of a
vocabulary that separates the labels best. A logistic model is fitted to labelled texts with two
penalties: on the size of its weights, and on what a swap changes. For every labelled sentence that
names a group of people, each name is swapped for others of its kind and for a word that names no
group; the mean square of the change of the sentence's score is added to the loss. So a name does
not count for or against a text by itself, however often the toxic labelled texts have it, while
what is said of the group still does.

The labelled texts are a bounded sample: at most `most_rows` labelled ids, those with the smallest
hash, outside the held-out fold. Counts of features and the swaps' second moments are Spark
aggregates; the moments and the sample's feature lists, of bounded size, reach the driver, which
solves by Newton steps. Every document is scored, each word by a look-up in a sorted table.

Defined cases: null, empty and wordless texts have no feature and get the model's base score; without
both labels in the sample every score is its smoothed share of label 1 (0.5 for an empty one); null
labels teach nothing; a null doc_id is in fold 0; repeated rows are scored each, and teach once; equally good features go by their hash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import crc32_mod, drop_written, written
from .decontam import word_list
from .encode import in_slices
from .words import LETTERS, bytes_of, mix, shingles, spans

#: Names of groups of people, of one kind in a row; the last word of a row names no group. A parameter, these are its default.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "kind"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("black", "white", "asian", "african", "european", "latino", "local"),
    ("immigrants", "refugees", "foreigners", "natives", "people"),
    ("blind", "deaf", "disabled", "old", "young", "tall"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "leute"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "gens"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "gente"),
)
_SENTENCES = re.compile(rb"[.!?\n]+")


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word and every pair of words, repeats included."""
    s = spans(raw, starts, LETTERS, lower=True)
    pairs, first = shingles(s, 2)
    return np.concatenate([s.hash, mix(pairs ^ np.uint64(2))]), np.concatenate([s.row, s.row[first]])


def copy_keys(batches):
    """toxic and text with three least hashes of runs of three words, of which near copies share one nearly always; for mapInArrow."""
    import pyarrow as pa

    for whole in batches:
        for batch in in_slices(whole, "text", 2 << 20):
            raw, starts = bytes_of(batch.column("text"))
            s = spans(raw, starts, LETTERS, lower=True)
            h, first = shingles(s, 3)
            row, keys = s.row[first], np.zeros((3, batch.num_rows), np.uint64)
            begin = np.searchsorted(row, np.arange(batch.num_rows))
            some = np.bincount(row, minlength=batch.num_rows) > 0
            other = [xxh64_intdigest(raw[starts[i] : starts[i + 1]].tobytes()) for i in np.flatnonzero(~some)]  # fewer words: by the text
            for k in range(3):
                keys[k, ~some] = other
                if some.any():
                    keys[k, some] = np.minimum.reduceat(mix(h ^ np.uint64(k + 1)), begin[some])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("text"), *(pa.array(k.view(np.int64)) for k in keys)],
                ["toxic", "text", "k0", "k1", "k2"])


def swapped(text: bytes, groups: dict[bytes, tuple[bytes, ...]], turns: int) -> list[tuple[bytes, list[bytes]]]:
    """Each sentence that names a group, with its words, and versions of it: the names swapped for the word
    that names no group, then for the next, second next, ... name of their kind."""
    out = []
    for sentence in _SENTENCES.split(text):
        words = word_list(sentence)
        if any(w in groups for w in words):
            def turn(word: bytes, k: int) -> bytes:
                if word not in groups:
                    return word
                kind = groups[word]
                return kind[-1] if k == 0 else kind[(kind.index(word) + k) % (len(kind) - 1)]

            out.append((b" ".join(words), [b" ".join(turn(w, k) for w in words) for k in range(turns + 1)]))
    return out


def _kinds(terms) -> dict[bytes, tuple[bytes, ...]]:
    """The names' kinds; the word that names no group is no name."""
    rows = [tuple(t.encode() for t in row) for row in terms]
    if any(len(r) < 2 for r in rows):
        raise ValueError("a kind needs a name and a word that names no group")
    return {name: row for row in reversed(rows) for name in row[:-1]}


@dataclass
class Model:
    """Sorted feature hashes with their weights; base: the score's log-odds without any feature."""

    hash: np.ndarray
    weight: np.ndarray
    base: float

    def present(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the vocabulary's features in each text, each once."""
        h, row = features(raw, starts)
        at = np.searchsorted(self.hash, h)
        hit = at < len(self.hash)
        hit[hit] = self.hash[at[hit]] == h[hit]
        n = max(len(self.hash), 1)
        keys = np.unique(row[hit] * n + at[hit])
        return keys // n, keys % n

    def score(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        row, at = self.present(raw, starts)
        odds = self.base + np.bincount(row, self.weight[at], len(starts) - 1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def solve(x: np.ndarray, y: np.ndarray, moments: np.ndarray, l2: float, swap: float, balance: float = 0.5, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and base that make the least of mean log loss + l2 / 2 |w|^2 + swap / 2 w' moments w, by damped Newton steps.

    balance: label 1 counts (zeros / ones) ** balance times in the mean: 0 as often as it stands, 1 as much as label 0.
    """
    share = np.where(y == 1, ((y == 0).sum() / max((y == 1).sum(), 1)) ** balance, 1.0)
    share /= share.sum()
    n, k = x.shape
    ones = np.concatenate([x, np.ones((n, 1), x.dtype)], 1)
    penalty = np.zeros((k + 1, k + 1))
    penalty[:k, :k] = l2 * np.eye(k) + swap * moments
    w = np.zeros(k + 1)

    def loss(w):
        z = ones @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(ones @ w)))
        gradient = ones.T @ (share * (p - y)) + penalty @ w
        curve = (ones * (share * p * (1 - p))[:, None].astype(x.dtype)).T @ ones + penalty
        step, size = np.linalg.solve(curve + 1e-9 * np.eye(k + 1), gradient), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, before, now = w - size * step, now, min(after, now)
        if before - now < 1e-9:
            break
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, held_out_of, terms=IDENTITY_TERMS, swap: float = 10.0, l2: float = 1e-4, vocabulary: int = 512,
        most_rows: int = 20_000, least_rows: int = 5, least_told: float = 12.0, turns: int = 3) -> Model:
    """The model of at most most_rows labelled texts outside the held-out fold.

    terms: names of groups, see IDENTITY_TERMS; swap: weight of the counterfactual penalty; turns: how
    many other names each is swapped for; vocabulary: features at most, of least_rows texts or more each
    and a log likelihood ratio of least_told or more with the label. Near copies of one text with one
    label, known by equal least hashes, teach once.
    """
    kinds = _kinds(terms)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = known.where(~held_out_of(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = named.select("doc_id", "h").join(F.broadcast(sample), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "h").limit(most_rows)
    sampled = named.join(F.broadcast(rows), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "toxic"])  # texts move only now, and most_rows of them
    keyed = sampled.select((F.col("toxic") == 1).cast("int").alias("toxic"), "text").mapInArrow(copy_keys, "toxic int, text string, k0 long, k1 long, k2 long")
    for key in ("k0", "k1", "k2"):
        keyed = keyed.groupBy("toxic", key).agg(F.min(F.struct("text", *(k for k in ("k0", "k1", "k2") if k != key))).alias("r")).select("toxic", key, "r.*")
    taught = written(keyed.select("toxic", "text"), "toxicity-sample")
    n_of = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, rows = n_of.get(1, 0), sum(n_of.values())
    if not 0 < ones < rows:
        share = (ones + 0.5) / (rows + 1)
        drop_written(taught)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))

    def slices(batches):
        for whole in batches:
            yield from in_slices(whole, "text", 2 << 20)

    def counts(batches):
        import pyarrow as pa

        for batch in slices(batches):
            h, row = features(*bytes_of(batch.column("text")))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            toxic = batch.column("toxic").to_numpy()[row[new]]
            distinct, at = np.unique(h[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(at, minlength=len(distinct))),
                pa.array(np.bincount(at, toxic, len(distinct)).astype(np.int64))], ["h", "n", "n1"])

    c, c1 = F.col("n"), F.col("n1")

    def part(a, b):  # of the log likelihood ratio of a feature and the label
        return F.when(a > 0, a * F.log(a * rows / b)).otherwise(0.0)

    told = part(c1, c * ones) + part(c - c1, c * (rows - ones)) + part(ones - c1, (rows - c) * ones) + part(rows - ones - c + c1, (rows - c) * (rows - ones))
    by_feature = taught.mapInArrow(counts, "h long, n long, n1 long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    picked = by_feature.where((c >= least_rows) & (told >= least_told)).orderBy(told.desc(), "h").limit(vocabulary).select("h").collect()
    m = Model(np.sort(np.array([r["h"] for r in picked], np.int64).view(np.uint64)), np.zeros(len(picked)), 0.0)
    sent, k = docs.sparkSession.sparkContext.broadcast(m), len(picked)

    def lists(batches):
        import pyarrow as pa

        for batch in slices(batches):
            row, at = sent.value.present(*bytes_of(batch.column("text")))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32)))], ["toxic", "at"])

    def changes(batches):
        """Sums of products of the changes that swaps make to two features, and the number of swaps (i, j = -1)."""
        import pyarrow as pa

        total, n = np.zeros((k, k)), 0
        names = np.sort(spans(*bytes_of(pa.array(sorted(kinds), pa.large_binary())), LETTERS).hash)
        for batch in slices(batches):
            s = spans(*bytes_of(batch.column("text")), LETTERS, lower=True)
            for text in batch.column("text").take(pa.array(np.unique(s.row[np.isin(s.hash, names)]))).to_pylist():
                for sentence, others in swapped(text.encode("utf-8", "replace"), kinds, turns):
                    row, at = sent.value.present(*bytes_of(pa.array([sentence, *others], pa.large_binary())))
                    own = np.bincount(at[row == 0], minlength=k)
                    for i in range(1, len(others) + 1):
                        d = np.bincount(at[row == i], minlength=k) - own
                        at_d = np.flatnonzero(d)
                        total[np.ix_(at_d, at_d)] += np.outer(d[at_d], d[at_d])
                        n += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], float(n)))], ["i", "j", "v"])

    got = taught.mapInArrow(lists, "toxic int, at array<int>").toArrow()
    x, y = np.zeros((got.num_rows, k), np.float32), got.column("toxic").to_numpy().astype(float)
    at = got.column("at").combine_chunks()
    x[np.repeat(np.arange(len(x)), np.diff(at.offsets.to_numpy())), at.values.to_numpy()] = 1
    moments, n = np.zeros((k, k)), 0.0
    for r in taught.mapInArrow(changes, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["i"] < 0:
            n = r["v"]
        else:
            moments[r["i"], r["j"]] = r["v"]
    m.weight, m.base = solve(x, y, moments / max(n, 1.0), l2, swap)
    sent.unpersist()
    drop_written(taught)
    return m


def scores(docs: DataFrame, labels: DataFrame, held_out_of, threshold: float = 0.7, **of_fit) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out_of, **of_fit))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, "text"):
                score = sent.value.score(*bytes_of(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                    pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fold_is(n: int, fold: int):
    return lambda col: crc32_mod(col, n) == fold

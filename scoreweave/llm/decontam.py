"""Benchmark decontamination: short test items found inside long documents.

Documents are partitioned by size: with n distinct word shingles, 2**c <= n < 2**(c + 1), a document's
one-permutation MinHash sketch has 2**c buckets of the hash range and keeps the least hash of each,
which is between 0.43 and 0.64 of its shingles. An item whose shingles the document contains to the
threshold shows a number of its own hashes in the sketch; how many it must show at least follows
from its size and the share kept, such that a contained item fails with a chance of at most MISS.
Items too small for that bound (fewer than 21 shingles at 0.8) are looked up by every shingle, so none
of them is missed. Exact containment of the shingles themselves decides on every candidate.

Items go to all tasks in blocks of bounded bytes, and a batch of documents is looked up in a block's
sorted hashes at once; more blocks mean more passes, never a larger broadcast.

Defined cases: words are runs of letters and digits, A-Z lower-cased; a text of fewer words than a
shingle is one shingle; null, empty and wordless texts and items match nothing; a repeated row
matches as often as it stands; a null doc_id or item_id is kept as such; an empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .encode import in_slices
from .words import LETTERS, LOWER, Spans, bytes_of, shingles, spans

KEPT = (1 - float(np.exp(-2))) / 2  # the share of 2 m distinct hashes that are the least of m buckets
MISS = 1e-4
FILTER_BITS = 22


def word_list(text: bytes) -> list[bytes]:
    table = bytes(int(LOWER[b]) if LETTERS[b] else 32 for b in range(256))
    return text.translate(table).split()


def shingle_set(text: bytes, k: int) -> set[bytes]:
    w = word_list(text)
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def row_shingles(s: Spans, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; a text of fewer than k words has one of all its words."""
    h, at = shingles(s, k)
    rows = s.row[at]
    counts = np.bincount(s.row, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return h, rows
    first = np.searchsorted(s.row, short)
    extra = np.array([shingles(Spans(s.hash[a : a + c], None, None, s.row[a : a + c]), int(c))[0][0] for a,
        c in zip(first, counts[short], strict=True)], np.uint64)
    return np.concatenate([h, extra]), np.concatenate([rows, short])


def sketch(hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the distinct hashes, sorted by row and hash, are the least of their bucket; sizes: of each row."""
    bits = np.maximum(np.floor(np.log2(np.maximum(sizes, 2))), 1).astype(np.uint64)
    bucket = hashes >> (np.uint64(64) - bits[rows])
    least = np.ones(len(hashes), bool)
    least[1:] = (bucket[1:] != bucket[:-1]) | (rows[1:] != rows[:-1])
    return least


def least_shown(shingles_of: np.ndarray, threshold: float) -> np.ndarray:
    """How many of an item's hashes a sketch shows at least, if its text contains the threshold's share; 0: no bound."""
    held = np.ceil(threshold * shingles_of - 1e-9)
    bound = np.maximum(np.floor(held * KEPT - np.sqrt(held * np.log(1 / MISS) / 2)), 1)  # Hoeffding
    return np.where((1 - KEPT) ** held <= MISS, bound, 0).astype(np.int64)


def sorted_sets(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted by row and hash."""
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


class _Postings:
    """Sorted hashes with the items that have them, behind a filter by their first bits."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        hashes, self.items = hashes[order], items[order]
        self.values, first = np.unique(hashes, return_index=True)
        self.bounds = np.append(first, len(hashes))
        self.first_bits = np.zeros(1 << FILTER_BITS, bool)
        self.first_bits[self.values >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and item of every hash that an item has."""
        maybe = np.flatnonzero(self.first_bits[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.searchsorted(self.values, hashes[maybe])
        hit = at < len(self.values)
        hit[hit] = self.values[at[hit]] == hashes[maybe][hit]
        at, rows = at[hit], rows[maybe[hit]]
        n = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(n)
        return np.repeat(rows, n), self.items[np.arange(n.sum()) + np.repeat(self.bounds[at] - (ends - n), n)]


class Items:
    """One block of items with their shingles' postings."""

    def __init__(self, rows: list[tuple[int, bytes]], k: int, threshold: float):
        import pyarrow as pa

        self.k, self.threshold, self.ids, self.texts = k, threshold, [i for i, _ in rows], [t for _, t in rows]
        raw, starts = bytes_of(pa.array(self.texts, pa.large_binary()))
        self.hash, self.row = sorted_sets(*row_shingles(spans(raw, starts, LETTERS, lower=True), len(rows), k))
        self.bounds = np.searchsorted(self.row, np.arange(len(rows) + 1))
        self.sizes = np.diff(self.bounds)
        self.least = least_shown(self.sizes, threshold)
        large = self.least[self.row] > 0
        self.large, self.small = (_Postings(self.hash[m], self.row[m]) for m in (large, ~large))
        self._sets: dict[int, set[bytes]] = {}

    def _set(self, i: int) -> set[bytes]:
        if i not in self._sets:
            if len(self._sets) > 1000:
                self._sets.clear()
            self._sets[i] = shingle_set(self.texts[i], self.k)
        return self._sets[i]

    def candidates(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Row and item of all pairs that a sketch, or the lookup of every shingle, does not rule out; of n sorted sets."""
        shown = sketch(hashes, rows, np.bincount(rows, minlength=n))
        out = []
        for postings, keep, need in ((self.large, shown, self.least), (self.small, slice(None), np.ceil(self.threshold * self.sizes - 1e-9))):
            row, item = postings.find(hashes[keep], rows[keep])
            pairs, times = np.unique(row.astype(np.int64) * max(len(self.ids), 1) + item, return_counts=True)
            pairs = pairs[times >= need[pairs % max(len(self.ids), 1)]]
            out += zip((pairs // max(len(self.ids), 1)).tolist(), (pairs % max(len(self.ids), 1)).tolist(), strict=True)
        return sorted(out)

    def found_in(self, raw: np.ndarray, starts: np.ndarray):
        """Row, item and containment of every item that a text contains to the threshold."""
        n = len(starts) - 1
        h, r = sorted_sets(*row_shingles(spans(raw, starts, LETTERS, lower=True), n, self.k))
        bounds, last, own = np.searchsorted(r, np.arange(n + 1)), -1, set()
        for row, item in self.candidates(h, r, n):
            want, mine = self.hash[self.bounds[item] : self.bounds[item + 1]], h[bounds[row] : bounds[row + 1]]
            at = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
            if (mine[at] == want).sum() < self.threshold * len(want) - 1e-9:
                continue
            if row != last:
                last, own = row, shingle_set(raw[starts[row] : starts[row + 1]].tobytes(), self.k)
            share = len(self._set(item) & own) / len(self._set(item))
            if share >= self.threshold - 1e-9:
                yield row, item, share


def _blocks(items: DataFrame, block_bytes: int):
    """Items in broadcast blocks of at most block_bytes of text (a single longer item stands alone)."""
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    block, size, any_sent = [], 0, False
    for item, text in texts.toLocalIterator():
        text = text.encode("utf-8", "replace")
        if block and size + len(text) > block_bytes:
            yield spark.sparkContext.broadcast(block)
            block, size, any_sent = [], 0, True
        block.append((item, text))
        size += len(text)
    if block or not any_sent:
        yield spark.sparkContext.broadcast(block)


def _found(sent, batch, text_col: str, k: int, threshold: float):
    """Of one slice: row, item_id and containment of every hit."""
    global _block
    if _block is None or _block[0] is not sent:
        _block = (sent, Items(sent.value, k, threshold))
    for row, item, share in _block[1].found_in(*bytes_of(batch.column(text_col))):
        yield row, _block[1].ids[item], share


_block: tuple | None = None


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, containment of every item of which the document holds the threshold's share of shingles."""
    plain, out = id_and_text(docs), None
    for sent in _blocks(items, block_bytes):

        def run(batches, sent=sent):
            import pyarrow as pa

            for whole in batches:
                for batch in in_slices(whole, "text", 2 << 20):
                    ids = batch.column("doc_id").to_pylist()
                    got = [(ids[i], item, share) for i, item, share in _found(sent, batch, "text", k, threshold)]
                    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], kind) for j,
                        kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "containment"])

        part = plain.mapInArrow(run, "doc_id long, item_id long, containment double")
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows that contain an item."""
    for sent in _blocks(items, block_bytes):

        def run(batches, sent=sent):
            import pyarrow as pa

            for whole in batches:
                for batch in in_slices(whole, "text", 2 << 20):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[i for i, _, _ in _found(sent, batch, "text", k, threshold)]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

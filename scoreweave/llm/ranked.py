"""Ranked lexical search: the best documents of every item, by term weights and saturating frequencies.

Documents stay where they are: each task makes posting lists of the documents that it reads, for the
terms of the items alone, and keeps every item's best of them; one window over items x tasks x k rows
ranks these. Within a task the search is a hybrid. An item's short lists are summed term at a time
into accumulators, which are then one iterator among the long lists, with its largest sum as bound.
All iterators are walked document at a time in stretches of documents: those whose bounds together
cannot reach the item's worst kept score bring up no documents, and are only looked up at the
documents that the others bring up while what is known of these, with the bounds still open, may
reach it. The kept scores go on from stretch to stretch, so lists are skipped more and more.

A term's weight needs its document frequency, so documents are read twice: once to count, once to
search. Items go to all tasks in blocks of bounded bytes; each further block is two further passes.
Found words are compared with terms by 64-bit hash and then by their bytes. Every score is exact.

Defined cases: words are runs of ASCII letters and digits and of all other characters beyond ASCII,
only A-Z lower-cased; null, empty and wordless texts have no terms; the rows of one item_id are one
item with the terms of all, those without an id too; each row of a repeated document is ranked;
equal scores go by doc_id, null last; items that meet nothing, and an empty table, give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text
from .decontam import word_list
from .encode import in_slices
from .words import LETTERS, LOWER, bytes_of, spans

NO_ID = (1 << 63) - 1


class Terms:
    """The distinct terms of a block of items, sorted by hash, and each item's terms."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        import pyarrow as pa

        self.ids = [i for i, _ in items]
        words = sorted({w for _, ws in items for w in ws})
        raw, starts = bytes_of(pa.array(words, pa.large_binary()))
        hashes = spans(raw, starts, LETTERS).hash if words else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.size = hashes[order], np.diff(starts)[order]
        place = {words[j]: i for i, j in enumerate(order.tolist())}
        self.terms_of = [np.array(sorted(place[w] for w in set(ws)), np.int64) for _, ws in items]
        self.spelt = np.zeros((len(words), max(map(len, words), default=1)), np.uint8)
        for i, j in enumerate(order.tolist()):
            self.spelt[i, : len(words[j])] = np.frombuffer(words[j], np.uint8)
        self.first_bits = np.zeros(1 << 16, bool)
        self.first_bits[self.hash >> np.uint64(48)] = True

    def postings(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term, row and frequency of every term in a text, by term and row; then the number of words of each text."""
        n, s = len(starts) - 1, spans(raw, starts, LETTERS, lower=True)
        maybe = np.flatnonzero(self.first_bits[s.hash >> np.uint64(48)])
        at = np.searchsorted(self.hash, s.hash[maybe])
        hit = at < len(self.hash)
        hit[hit] = self.hash[at[hit]] == s.hash[maybe][hit]
        at, word = at[hit], maybe[hit]
        same = s.end[word] - s.start[word] == self.size[at]
        at, word = at[same], word[same]
        order = np.argsort(-self.size[at], kind="stable")  # from long to short, so that the words with a letter at j lead
        at, word = at[order], word[order]
        same, longer = np.ones(len(at), bool), np.searchsorted(-self.size[at], -np.arange(self.spelt.shape[1]))
        for j, m in enumerate(longer.tolist()):
            same[:m] &= LOWER[raw[s.start[word[:m]] + j]] == self.spelt[at[:m], j]
        keys, tf = np.unique(at[same] * max(n, 1) + s.row[word[same]], return_counts=True)
        return keys // max(n, 1), keys % max(n, 1), tf, np.bincount(s.row, minlength=n)


def _blocks(items: DataFrame, block_bytes: int):
    """Items with their terms in blocks of at most block_bytes of text (a single longer item stands alone)."""
    text = F.concat_ws(" ", F.collect_list("text"))
    block, size = [], 0
    for item, text in items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(text.alias("text")).toLocalIterator():
        words = word_list(text.encode("utf-8", "replace"))
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(text)
    if block:
        yield block


def _counts(docs: DataFrame, sent) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and documents with each of the block's terms, over all documents."""

    def run(batches):
        import pyarrow as pa

        terms = sent.value
        df, n_docs, n_terms = np.zeros(len(terms.hash), np.int64), 0, 0
        for whole in batches:
            for batch in in_slices(whole, "text"):
                term, _, _, size = terms.postings(*bytes_of(batch.column("text")))
                df += np.bincount(term, minlength=len(df))
                n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + int(size.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, n_terms]))], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r["term"]: r["n"] for r in sums}
    df = np.zeros(len(sent.value.hash), np.int64)
    for term, count in n.items():
        if term >= 0:
            df[term] = count
    return n.get(-1, 0), n.get(-2, 0), df


class Best:
    """The k best documents of one item so far: score from high to low, then id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to be among them."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def search(best: Best, lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, short: int, stretch: int = 4096) -> int:
    """Offer the documents of one item's posting lists (sorted rows, parts of the score); returns how many were looked at.

    Lists of at most `short` rows are summed into accumulators first. ids: of the rows.
    """
    few = [x for x in lists if len(x[0]) <= short]
    walked = [(int(part.max()), rows, part) for rows, part in lists if len(rows) > short]
    if few:
        rows, at = np.unique(np.concatenate([r for r, _ in few]), return_inverse=True)
        sums = np.zeros(len(rows), np.int64)
        np.add.at(sums, at, np.concatenate([p for _, p in few]))
        walked.append((int(sums.max()), rows, sums))
    walked.sort(key=lambda x: x[0])
    bounds, seen = np.cumsum([b for b, _, _ in walked]), 0  # bounds[i]: what iterators 0 to i give at most
    for begin in range(0, len(ids), stretch):
        lead = int(np.searchsorted(bounds, best.least))  # those before it reach the worst kept score in no document
        if lead == len(walked):
            break
        sums, met = np.zeros(min(stretch, len(ids) - begin), np.int64), np.zeros(min(stretch, len(ids) - begin), bool)
        for _, rows, part in walked[lead:]:
            a, b = np.searchsorted(rows, (begin, begin + stretch))
            sums[rows[a:b] - begin] += part[a:b]
            met[rows[a:b] - begin] = True
        docs = np.flatnonzero(met)
        known = sums[docs]
        seen += len(docs)
        for i in range(lead - 1, -1, -1):
            able = known + bounds[i] >= best.least
            docs, known = docs[able], known[able]
            _, rows, part = walked[i]
            at = np.minimum(np.searchsorted(rows, docs + begin), len(rows) - 1)
            known = known + np.where(rows[at] == docs + begin, part[at], 0)
        able = known >= best.least
        if able.any():
            best.offer(known[able], ids[docs[able] + begin])
    return seen


def _best_in_tasks(docs: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int, k: int, short_share: float, most_postings: int) -> DataFrame:
    """item_id, doc_id and score of every item's k best documents of each task."""

    def run(batches):
        import pyarrow as pa

        terms = sent.value
        best, held, size = [Best(k) for _ in terms.ids], [], 0

        def walk():
            """All lists gathered so far, one after another for each item."""
            ids = np.concatenate([h[0] for h in held])
            before = np.cumsum([0, *(len(h[0]) for h in held)])
            term, row = np.concatenate([h[1] for h in held]), np.concatenate([h[2] + b for h, b in zip(held, before, strict=False)])
            order = np.argsort(term, kind="stable")  # rows go up within a slice and from slice to slice
            row, part = row[order], np.concatenate([h[3] for h in held])[order]
            bounds = np.searchsorted(term[order], np.arange(len(terms.hash) + 1))
            for i, own in enumerate(terms.terms_of):
                lists = [(row[a:b], part[a:b]) for a, b in zip(bounds[own].tolist(), bounds[own + 1].tolist(), strict=True) if b > a]
                if lists:
                    search(best[i], lists, ids, int(short_share * len(ids)))

        for whole in batches:
            for batch in in_slices(whole, "text"):
                term, row, tf, n = terms.postings(*bytes_of(batch.column("text")))
                m = 10 + 90 * n.astype(np.int64) * n_docs // max(n_terms, 1)
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                held.append((batch.column("doc_id").fill_null(NO_ID).to_numpy(), term, row, part))
                size += len(term)
                if size >= most_postings:
                    walk()
                    held, size = [], 0
        if held:
            walk()
        at = np.repeat(np.arange(len(best)), [len(b.doc) for b in best])
        doc = np.concatenate([np.empty(0, np.int64), *(b.doc for b in best)])
        score = np.concatenate([np.empty(0, np.int64), *(b.score for b in best)])
        yield pa.RecordBatch.from_arrays([pa.array([terms.ids[i] for i in at], pa.int64()), pa.array(doc, mask=doc == NO_ID), pa.array(score)],
            ["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, short_share: float = 0.05, block_bytes: int = 16 << 20,
        most_postings: int = 4_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k documents of each item with the highest scores above 0.

    short_share: lists with at most this share of a task's documents are summed first. block_bytes: of
    the items' text in one broadcast. most_postings: that a task gathers before it walks them.
    """
    spark, plain, out = docs.sparkSession, id_and_text(docs), None
    for block in _blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(Terms(block))
        n_docs, n_terms, df = _counts(plain, sent)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        part = _best_in_tasks(plain, sent, weights, n_docs, n_terms, k, short_share, most_postings)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

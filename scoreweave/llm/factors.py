"""Removal of byte strings that occur earlier: longest-previous-factor arrays over repeated stretches.

A text is the bytes of one document; matches never cross documents. Every string of `length` bytes
has an anchor: the least hash among its windows of `k` bytes. Strings in a row with the same anchor
are a run. Equal strings have equal anchors, so only runs whose anchor stands twice can match, and
those are found by counting, with partial aggregates before every shuffle.

Runs with equal bytes are one stretch, and all but its first place are copies whole; 64-bit hashes
of the bytes under an equal 64-bit anchor stand for equal runs. The different stretches of an anchor
are put in suffix order: their suffixes whose first `length` bytes stand twice (others have no factor
of that length) are sorted by their bytes, neighbours' common prefixes are measured, and the previous
and next smaller positions in that order give each suffix's longest previous factor, as far as its
stretch goes. A factor of `length` bytes or more is a later copy of what starts earlier, and its bytes go.

An anchor with more than `most_runs` different stretches (a short passage between ever other words) is
not sorted in one task: the stretches alone are anchored again by longer windows, so that few of them
share an anchor, and go the same way. The last windows are whole strings: equal ones are equal runs.

Defined cases: null or empty text has no bytes; a text shorter than the length loses nothing; a null
doc_id stands before all others; different texts with one doc_id are ordered by their hash; of equal
rows one is the first and the others are its copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, id_and_text, written
from .encode import in_slices, texts_of
from .words import _power, bytes_of, mix

SEGMENT = 1 << 16  # arrays of a segment stay in a core's cache
PLACE = np.uint64((1 << 20) - 1)  # bits of a window's place in its segment


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return x if size == w else op(x[: len(x) - (w - size)], x[w - size :])


def runs(raw: np.ndarray, starts: np.ndarray, length: int, k: int):
    """Of many texts in one buffer: anchor, hash of the bytes, row, start in the text and strings of each run.

    Windows are compared by the upper bits of their hashes, and of equal ones the first counts, so
    that the least one's place comes with it. Strings with one place are a run: at most length - k + 1
    of them, all different. Runs side by side with the same anchor (the window stands twice, as in
    periodic bytes) may hold equal strings: they are one run, whose first string becomes a run of its
    own, so that the anchor counts twice and its runs differ. Runs end at segments of the buffer.
    """
    w, top = length - k + 1, len(raw)
    up, down = _power(SEGMENT + length + 1)
    places = np.arange(SEGMENT + length, dtype=np.uint64)
    for x in range(0, top, SEGMENT):
        part = raw[x : x + SEGMENT + length - 1]
        m = len(part) - length + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            h = sums[k:] - sums[:-k]
            h *= down[: len(h)]
        least = h & ~PLACE
        least |= places[: len(h)]
        least = _sliding(least, w, np.minimum)
        ends = starts[np.searchsorted(starts, x, "right") : np.searchsorted(starts, x + m + length)] - x
        edges = np.concatenate([ends, ends - length + 1])  # strings that would cross the end of a text are between these
        begins = np.concatenate([[True], least[1:] != least[:-1]])
        begins[edges[(edges > 0) & (edges < m)]] = True
        a = np.flatnonzero(begins)
        b = np.append(a[1:], m)
        row = np.searchsorted(starts, a + x, "right") - 1
        fits = a + x + length <= starts[row + 1]
        if not fits.any():
            continue
        a, b, row = a[fits], b[fits], row[fits]
        anchor = mix(h[least[a] & PLACE])
        head = np.concatenate([[True], (a[1:] != b[:-1]) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        if not head.all():
            at = np.flatnonzero(head)
            several = (np.diff(np.append(at, len(a))) > 1).astype(np.int64)
            a, b, anchor = a[at], b[np.append(at[1:], len(a)) - 1], anchor[at]
            pieces = several - -(b - a - several) // w
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a, b, anchor, several = (np.repeat(v, pieces) for v in (a, b, anchor, several))
            a += several * (nth > 0) * (1 + (nth - 1) * w)
            b = np.where(several == 0, b, np.where(nth == 0, a + 1, np.minimum(a + w, b)))
            row = np.searchsorted(starts, a + x, "right") - 1
        with np.errstate(over="ignore"):
            content = mix((sums[b - 1 + length] - sums[a]) * down[a] + mix((b - a).astype(np.uint64)))
        yield anchor, content, row, a + x - starts[row], b - a


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position (0..n-1), how much of the suffix there also starts at a smaller position.

    order: positions in suffix order; lcp[i]: common prefix of order[i - 1] and order[i]. One pass
    with a stack: where a position leaves it, its neighbours are the previous and next smaller ones.
    """
    out = np.zeros(len(order), np.int64)
    stack: list[tuple[int, int]] = []  # position, common prefix with the position below it
    for i, (p, l) in enumerate(zip(order.tolist(), lcp.tolist(), strict=True)):
        l = l if i else 0
        while stack and stack[-1][0] > p:
            q, below = stack.pop()
            out[q] = max(below, l)
            l = min(below, l)
        stack.append((p, l))
    for p, l in stack:
        out[p] = l
    return out


def previous_factors(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each suffix data[begin:begin + size]; suffixes come by position, of length bytes or more.

    Factors shorter than length are given as 0: only intervals of the suffix order whose common
    prefixes reach the length are walked.
    """
    width = int(size.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    strings = np.empty((len(size), width + 2), np.uint8)
    strings[:, :width] = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    strings[:, :width][np.arange(width) >= size[:, None]] = 0
    strings[:, width:] = size.astype(">u2").view(np.uint8).reshape(-1, 2)  # of strings that differ in zeros at their ends, the shorter first
    order = np.argsort(strings.view(f"V{width + 2}").ravel(), kind="stable")
    strings = strings[order]
    differs = strings[1:, :width] != strings[:-1, :width]
    lcp = np.where(differs.any(1), differs.argmax(1), width)
    lcp = np.minimum(lcp, np.minimum(size[order[1:]], size[order[:-1]]))
    joined = np.concatenate([[False], lcp >= length, [False]])
    member = joined[1:] | joined[:-1]
    out = np.zeros(len(size), np.int64)
    # Two suffixes by themselves: the later one's factor is their common prefix. Others are walked.
    two = np.flatnonzero(joined[1:-1] & ~joined[:-2] & ~joined[2:])
    out[np.maximum(order[two], order[two + 1])] = lcp[two]
    member[two] = member[two + 1] = False
    if member.any():
        rows = order[member]
        ranks = np.empty(len(rows), np.int64)
        ranks[np.argsort(rows, kind="stable")] = np.arange(len(rows))
        before = np.where(joined[:-1], np.concatenate([[0], lcp]), 0)[member]
        out[rows] = longest_previous_factor(ranks, before)[ranks]
    return out


def later_copies(did, th, start, data: np.ndarray, begins: np.ndarray, length: int):
    """did, th, begin, end of the bytes that stand earlier, of stretches data[begins[i]:begins[i + 1]] at start in their documents.

    Only suffixes whose first length bytes stand twice (by their hash: equal strings have equal ones)
    are put in order. Spans that touch are one.
    """
    by = np.lexsort((start, th, did))
    did, th, start = did[by], th[by], start[by]
    doc = np.cumsum(np.concatenate([[0], (did[1:] != did[:-1]) | (th[1:] != th[:-1])]))
    n = np.diff(begins)[by] - length + 1
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = begins[:-1][by][row] + nth
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], out=sums[1:])
        h = (sums[begin + length] - sums[begin]) * down[begin]
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    row, begin = row[twice], begin[twice]
    place = (doc << 40)[row] | start[row] + nth[twice]
    # Equal rows of documents may be cut into other runs: their strings count once.
    place, one = np.unique(place, return_index=True)
    row, begin = row[one], begin[one]
    if not len(place):
        return did[:0], th[:0], start[:0], start[:0]
    factor = previous_factors(data, begin, begins[1:][by][row] - begin, length)
    hit = factor >= length
    first, last = place[hit], np.maximum.accumulate((place + factor)[hit])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]])[: len(first)])
    row = row[hit][new]
    below = (1 << 40) - 1
    return did[row], th[row], first[new] & below, last[np.append(new[1:], len(last))[: len(new)] - 1] & below


def _keyed(docs: DataFrame) -> DataFrame:
    plain = id_and_text(docs)
    return plain.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), "text")


def _runs(docs: DataFrame, length: int, k: int, whole: bool) -> DataFrame:
    """Anchors of all runs; with whole, the runs themselves."""

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for batch in in_slices(big, "text", 4 << 20):
                raw, starts = bytes_of(batch.column("text"))
                if whole:
                    did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
                for anchor, content, row, start, n in runs(raw, starts, length, k):
                    if whole:
                        cols = [anchor.view(np.int64), content.view(np.int64), did[row], th[row], start << 10 | n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "content", "did", "th", "place"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], ["anchor"])

    if whole:
        return docs.select("did", "th", "text").mapInArrow(run, "anchor long, content long, did long, th long, place long")
    return docs.select("text").mapInArrow(run, "anchor long")


def _cut(keyed: DataFrame, stretches: DataFrame, emit, schema: str) -> DataFrame:
    """emit(batch, lists of the rows' stretches) over the documents that hold stretches (did, th, anchor, place)."""
    lists = stretches.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "place")).alias("runs"))
    return keyed.select("did", "th", "text").join(lists, ["did", "th"]).mapInArrow(emit, schema)


def _by_suffix_order(keyed: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """did, th, begin, end of bytes in first stretches that stand earlier in other stretches of the anchor."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for did, th, text, own in zip(*(batch.column(c).to_pylist() for c in ("did", "th")), texts_of(batch.column("text")),
                batch.column("runs"), strict=True):
                anchors, places = (own.values.field(c).to_numpy() for c in ("anchor", "place"))
                for anchor, place in zip(anchors.tolist(), places.tolist(), strict=True):
                    start, n = place >> 10, place & 1023
                    rows.append((anchor, did, th, start, text[start : start + n - 1 + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c,
                    k in zip(zip(*rows[i : i + 20_000], strict=True), kinds, strict=True)], ["anchor", "did", "th", "start", "data"])

    def decide(batches):
        import pyarrow as pa

        def settle(held):
            """Whole groups of anchors: suffixes of different anchors share no string of length bytes."""
            t = pa.Table.from_batches(held)
            data, begins = bytes_of(t.column("data").combine_chunks())
            got = later_copies(*(t.column(c).to_numpy() for c in ("did", "th", "start")), data, begins, length)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["did", "th", "begin", "end"])

        # Rows come sorted by anchor; a chunk of about 1000 runs is settled at once and ends between two anchors.
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and held[-1].column("anchor")[-1].as_py() != int(anchor[0]):
                ends = np.concatenate([[0], ends])
            begin = 0
            for stop in ends.tolist():
                if size + stop - begin >= 1000:
                    held.append(batch.slice(begin, stop - begin))
                    yield settle(held)
                    held, size, begin = [], 0, stop
            held.append(batch.slice(begin))
            size += batch.num_rows - begin
        if held:
            yield settle(held)

    cutout = _cut(keyed, stretches, cut, "anchor long, did long, th long, start long, data binary")
    return cutout.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(decide, "did long, th long, begin long, end long")


def _longer_windows(keyed: DataFrame, stretches: DataFrame, length: int, k: int) -> DataFrame:
    """The runs inside stretches (did, th, anchor, place), by windows of k bytes: as _runs has them for whole texts."""

    def cut(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            parts, at = [], []  # the stretches' bytes; document and start of each
            for i, (text, own) in enumerate(zip(texts_of(batch.column("text")), batch.column("runs"), strict=True)):
                for place in own.values.field("place").to_numpy().tolist():
                    start, n = place >> 10, place & 1023
                    parts.append(text[start : start + n - 1 + length])
                    at.append((i, start))
            if not parts:
                continue
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            document, begin = np.array(at, np.int64).reshape(-1, 2).T
            data = b"".join(parts)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            for anchor, _, row, start, n in runs(np.frombuffer(data, np.uint8), starts, length, k):
                first = starts[row] + start
                # Of its own kind, as window and run may be the same bytes here.
                content = np.array([xxh64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (first + n - 1 + length).tolist(), strict=True)], np.uint64)
                cols = [anchor.view(np.int64), content.view(np.int64), did[document[row]], th[document[row]], begin[row] + start << 10 | n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "content", "did", "th", "place"])

    return _cut(keyed, stretches, cut, "anchor long, content long, did long, th long, place long")


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, most_runs: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) of every document."""
    if not 1 <= k <= length or length > 900:
        raise ValueError("k must lie between 1 and length, length below 900")
    keyed = _keyed(docs)
    # A table of its own, so that a hot anchor's rows in the join below are split.
    repeated = written(_runs(keyed, length, k, False).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    some = written(_runs(keyed, length, k, True).join(repeated, "anchor", "left_semi"), "runs")
    drop_written(repeated)

    gone, used = [], []
    for longer in ((k + 3 * length) // 4, length, None):
        by_bytes = some.groupBy("anchor", "content").agg(F.min(F.struct("did", "th", "place")).alias("first"), F.count("*").alias("n"))
        first = written(by_bytes, "first-runs")
        varied = written(first.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "varied")
        used += [some, first, varied]
        later = some.join(first.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"]).where("struct(did, th, place) <> first")
        gone.append(later.select("did", "th", F.shiftright("place", 10).alias("begin"),
            (F.shiftright("place", 10) + F.col("place").bitwiseAND(1023) - 1 + length).alias("end")))
        if longer is None:  # runs of one string, so that different ones share none
            break
        mixed = first.select("anchor", "first.*").join(varied, "anchor")
        gone.append(_by_suffix_order(keyed, mixed.where(F.col("kinds") <= most_runs), length))
        if varied.where(F.col("kinds") > most_runs).isEmpty():
            break
        some = written(_longer_windows(keyed, mixed.where(F.col("kinds") > most_runs), length, longer), "runs")
    spans = written(reduce(DataFrame.union, gone).groupBy("did", "th").agg(F.collect_set(F.struct("begin", "end")).alias("gone")), "spans")
    for done in used:
        drop_written(done)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [[] for _ in range(5)]
            for text, own in zip(texts_of(batch.column("text")), batch.column("gone"), strict=True):
                removed = spans_n = 0
                kept = text
                if own.is_valid:
                    begin, end = (own.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    new = np.concatenate([[True], begin[1:] > end[:-1]])
                    begin, end = begin[new], end[np.concatenate([new[1:], [True]])]
                    removed, spans_n = int((end - begin).sum()), len(begin)
                    view = memoryview(text)
                    kept = b"".join(view[i:j] for i, j in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True))
                for c, v in zip(cols, (len(text), removed, spans_n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"),
                *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    marked = keyed.join(spans, ["did", "th"], "left").select("doc_id", "th", "text", "gone")
    return marked.mapInArrow(apply, "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame, length: int = 100, k: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; of equal rows, all but one are copies whole."""
    out = remove_repeats(docs, length, min(k, length))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    counted = out.groupBy("th", *names).agg(F.count("*").alias("rows"))
    one = counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copy = (F.col("nth") > 1) & (F.col("n_bytes") >= length)
    return one.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )

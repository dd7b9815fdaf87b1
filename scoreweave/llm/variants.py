"""Spelling variants: words of a corpus that differ by one character, and the frequent form each goes back to.

Neighbours come from permuterm rotations. A word closed by a terminator has a rotation for each place:
what follows the place, the terminator, what stands before it. Words that differ in one character at a
place have rotations there that are equal but for their last character, and the word without that
character has the same rotation without it. So all rotations are sorted by range, each run of rotations
with one prefix is a group (at most one word without the character, and one for each character that may
stand there), and a scan of the group gives every member its neighbours. A group never has more members
than the alphabet has characters, and only sums and best neighbours leave it. Where a run of equal
characters gives a shorter word at several places, the first of them counts.

Forms point from a word to a word at least twice as frequent, so chains have at most 63 links, and
doubling of pointers finds their ends in seven joins at most.

Defined cases: a null text has no words; a null doc_id is the empty string before the colon of the
checksum; rows of one id count each; words of any length are kept whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, id_and_text, written
from .encode import in_slices
from .words import LOWER, bytes_of, spans

END = "$"


def _crc_table() -> np.ndarray:
    """Of each byte, by the reflected polynomial of crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and the characters from U+00C0 to U+00FF, which are the byte C3 and one more."""
    inside = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    lead = np.flatnonzero(raw == 0xC3)
    inside[lead] = True
    inside[lead + 1] = True
    return inside


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every span of the bytes, carried on from the one before it."""
    order = np.argsort(start - end, kind="stable")
    at, state = start[order], ~before[order].astype(np.uint32)
    sizes = (end - start)[order]
    reach = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    for j, n in enumerate(reach.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def noisy_words(docs: DataFrame, least: int = 5, one_in: int = 97) -> DataFrame:
    """word and n (occurrences) of each task's slices: letter runs of `least` code points or more, one in `one_in` of them with
    a code point deleted as the checksum of id and run says."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, "text", 4 << 20):
                raw, starts = bytes_of(batch.column("text"))
                data = LOWER[raw]
                s = spans(raw, starts, None, lower=True, keep=letters(raw))
                ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
                before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                h = checksums(data, s.start, s.end, before[s.row])
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)])
                size = points[s.end] - points[s.start]
                struck = h % one_in == 0
                whole_words = np.flatnonzero(~struck & (size >= least))
                _, first, n = np.unique(s.hash[whole_words], return_index=True, return_counts=True)
                at = whole_words[first]
                words = [data[a:b].tobytes().decode() for a, b in zip(s.start[at].tolist(), s.end[at].tolist(), strict=True)]
                counts = n.tolist()
                for i in np.flatnonzero(struck & (size > least)):
                    word = data[s.start[i] : s.end[i]].tobytes().decode()
                    cut = int(h[i]) % len(word)
                    words.append(word[:cut] + word[cut + 1 :])
                    counts.append(1)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    return id_and_text(docs).mapInArrow(run, "word string, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and near (n and word of the most frequent neighbour, the smallest word on a tie) of the words (word, n) that have one."""
    place = F.explode(F.sequence(F.lit(0), F.length("word")))
    placed = words.select("word", "n", place.alias("i"))
    before, at, after = F.expr("left(word, i)"), F.expr("substr(word, i + 1, 1)"), F.expr("substr(word, i + 1)")
    rest = F.expr("substr(word, i + 2)")
    whole = F.struct(F.concat(after, F.lit(END), before).alias("key"), F.lit("").alias("at"))
    less = F.struct(F.concat(rest, F.lit(END), before).alias("key"), at.alias("at"))
    rotated = placed.select("word", "n", F.explode(F.when(at == "", F.array(whole)).otherwise(F.array(whole, less))).alias("r"))
    # The range partitioning of the sort holds each prefix's run together, so the window and the groups need no other exchange.
    sorted_ = rotated.select("r.key", "r.at", "word", "n").repartitionByRange("key").sortWithinPartitions("key", "at")
    runs = sorted_.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    member = F.struct((-F.col("n")).alias("order"), "word", "at")
    groups = runs.groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("all")).select("all", F.expr("right(key, 1)").alias("last"))
    # The word without the character is no neighbour of the one that repeats the character before it: an earlier place has that pair.
    one = groups.select("all", "last", F.explode("all").alias("m"))
    near = one.select("m.word", F.expr("filter(all, o -> o.at <> m.at AND NOT (o.at = '' AND m.at = last) AND NOT (m.at = '' AND o.at = last))").alias("near"))
    best = near.where(F.size("near") > 0).select("word", F.size("near").alias("k"), F.expr("near[0]").alias("b"))
    summed = best.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("b.order", "b.word")).alias("b"))
    return summed.select("word", "n_near", F.struct((-F.col("b.order")).alias("n"), F.col("b.word").alias("word")).alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the forms that follow one another, of word and form (each word once, no cycles)."""
    jumps = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(jumps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "variant-roots")
        drop_written(jumps)
        jumps = after.select("word", "root")
        if not after.where("moved").head(1):
            return jumps


def spelling_groups(docs: DataFrame, least: int = 5, least_n: int = 3, times: int = 2, one_in: int = 97) -> DataFrame:
    """word, n, form (its most frequent neighbour if at least `times` as frequent), form_n, n_near and root of every word.

    Words have at least `least` code points and stand at least least_n times.
    """
    counted = noisy_words(docs, least, one_in).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    words = written(counted, "variant-words")
    found = written(neighbours(words), "variant-neighbours")
    far = F.col("near.n") >= times * F.col("n")
    joined = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("near.word")).alias("form"), F.when(far, F.col("near.n")).alias("form_n"))
    formed = written(joined, "variant-forms")
    for done in (words, found):
        drop_written(done)
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

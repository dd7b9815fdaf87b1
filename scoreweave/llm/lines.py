"""Line dedup: repeated runs of lines, found by distributed prefix doubling over line ids.

The suffixes of all documents' line sequences are ranked by their first 1, 2, 4, ... lines. A round
names the pairs of two ranks of the round before: distinct pairs are counted (a partial aggregate,
so a line that a third of all documents share is one row), then range sorted, and numbered in that
order. A pair that stands once settles its suffix, which leaves the
rounds; they end when nothing repeats or no interval asks for more. The suffixes of one rank after
round k are an interval of the suffix array whose common prefix is at least 2**k lines.

A line goes if a run of lines around it that holds min_words words or more also starts earlier, on
the input; earlier is a smaller doc_id, or earlier in the document. The suffixes that share their
first n lines, for any n, are an interval of the suffix array with a longest common prefix of n or
more; it is named by n, the rank of the first 2**k lines and that of the last 2**k, 2**k being the
largest power in n, and its first member is the earliest start of the run. A maximal repeated run
of min_words words or more is the union of the shortest stretches with min_words words in it, one
from each of its lines on and one up to each, so a line's run is decided by the intervals of these
two lengths, whatever the length of the maximal run is.

Maximal stretches of lines that go are the runs.

Only DataFrame functions are used. Ranks come from the order of rows, so each round is written.

Defined cases: null text is empty, and an empty text is one empty line; lines are compared as they
stand, and equal 128-bit hashes count as equal lines; a null doc_id stands before all others;
different texts with one doc_id are ordered by their hash; equal rows (same id and text) are one
text, of which one row stays and the others lose every line; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

WORD = r"[^\x20\x09-\x0D]+"
TEXT = ("did", "th")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as a struct, with the text's key: did (the id, nulls first) and th (hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("th"))


def _rounds(lines: DataFrame, most: int):
    """The rounds' steps (1, 2, 4, ... up to most) and suffixes whose stretch repeats: did, th, i and rank."""
    active, keys, step = lines.select(*TEXT, "i", "id1", "id2"), ["id1", "id2"], 1
    while True:
        named = active.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")
        ranks = written(named.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("rank")), "line-ranks")
        ranked = written(active.join(ranks, keys).select(*TEXT, "i", "rank"), "line-suffixes")
        drop_written(ranks)
        yield step, ranked
        if 2 * step > most or ranked.isEmpty():
            return
        ahead = Window.partitionBy(*TEXT).orderBy("i").rangeBetween(step, step)
        active = ranked.select(*TEXT, "i", F.col("rank").alias("here"), F.max("rank").over(ahead).alias("ahead")).where("ahead is not null")
        keys, step = ["here", "ahead"], 2 * step


def shortest_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """did, th, i, n: the shortest stretch from each line on, and up to each line, that holds min_words words."""
    so_far = Window.partitionBy(*TEXT).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.select(*TEXT, "i", F.sum("words").over(so_far).alias("upto"), "words").withColumn("before", F.col("upto") - F.col("words"))
    # Lines and the word counts that are asked for, in one order: the last line so far is the nearest that reaches the count.
    on = counted.select(*TEXT, "i", F.col("upto").alias("v"), F.lit(1).alias("asks")).union(counted.select(*TEXT, "i", F.col("before") + min_words, F.lit(0)))
    back = counted.select(*TEXT, "i", F.col("before").alias("v"), F.lit(0).alias("asks")).union(counted.select(*TEXT, "i", F.col("upto") - min_words, F.lit(1)))
    down = Window.partitionBy(*TEXT).orderBy(F.desc("v"), F.desc("asks"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*TEXT).orderBy("v", "asks", "i").rowsBetween(Window.unboundedPreceding, 0)
    ends = on.select(*TEXT, "i", "asks", F.min(F.when(F.col("asks") == 1, F.col("i"))).over(down).alias("end")).where("asks = 0 and end is not null")
    begins = back.select(*TEXT, "i", "asks", F.max(F.when(F.col("asks") == 0, F.col("i"))).over(up).alias("begin")).where("asks = 1 and begin is not null")
    return ends.select(*TEXT, "i", (F.col("end") - F.col("i") + 1).alias("n")).union(begins.select(*TEXT, F.col("begin").alias("i"),
        (F.col("i") - F.col("begin") + 1).alias("n"))).distinct()


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """did, th, i, n: stretches of n lines from line i that are not the first of their interval; every run of
    lines with min_words words that starts earlier is a union of them."""
    asked = written(shortest_stretches(lines, min_words).withColumn("step", F.expr("shiftleft(1, length(bin(n)) - 1)")), "line-stretches")
    longest = asked.agg(F.max("step")).head()[0] or 1
    rounds = list(_rounds(lines, longest))
    named = reduce(DataFrame.union, [ranked.select(*TEXT, "i", F.lit(step).alias("step"), "rank") for step, ranked in rounds])
    first = asked.join(named.withColumnRenamed("rank", "first"), [*TEXT, "i", "step"])
    last = named.select(*TEXT, F.col("i").alias("at"), "step", F.col("rank").alias("last"))
    both = first.withColumn("at", F.col("i") + F.col("n") - F.col("step")).join(last, [*TEXT, "at", "step"])
    both = written(both.select(*TEXT, "i", "n", "first", "last"), "line-intervals")
    for done in (asked, *(ranked for _, ranked in rounds)):
        drop_written(done)
    here, interval = F.struct(*TEXT, "i"), ["n", "first", "last"]
    earliest = both.groupBy(*interval).agg(F.count("*").alias("times"), F.min(here).alias("earliest")).where("times > 1").drop("times")
    earliest = written(earliest, "line-earliest")  # a table, so that the rows of a large interval are split in the join
    return both.join(earliest, interval).where(here != F.col("earliest")).select(*TEXT, "i", "n")


def without_repeats(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """row, did, th, n_lines, n_removed, n_runs and kept (the text without the lines that go) for every row."""
    keyed = _keyed(docs)
    split = keyed.select(*TEXT, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = split.select(*TEXT, "i", F.xxhash64("line").alias("id1"), F.xxhash64(F.lit(1), "line").alias("id2"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
    lines = written(lines.dropDuplicates([*TEXT, "i"]), "lines")
    going = later_copies(lines, min_words)

    # +1 where a stretch begins and -1 after it; a line goes where the sum is above zero.
    marks = going.select(*TEXT, "i", F.lit(1).alias("d")).union(going.select(*TEXT, (F.col("i") + F.col("n")).alias("i"),
        F.lit(-1).alias("d"))).withColumn("line", F.lit(False))
    both = lines.select(*TEXT, "i", F.lit(0).alias("d"), F.lit(True).alias("line")).union(marks).repartition(*TEXT)
    so_far = Window.partitionBy(*TEXT).orderBy("i")
    gone = both.groupBy(*TEXT, "i").agg(F.sum("d").alias("d"), F.max("line").alias("line")).withColumn("gone",
        F.sum("d").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) > 0).where("line")
    begins = gone.withColumn("begins", F.col("gone") & ~F.coalesce(F.lag("gone").over(so_far), F.lit(False)))
    flags = begins.groupBy(*TEXT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "gone"))), lambda x: x["gone"]).alias("flags"),
        F.count("*").alias("n_lines"), F.count_if("gone").alias("n_removed"), F.count_if("begins").alias("n_runs"),
    )
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.get("flags", i)), "\n")
    return keyed.join(flags, [*TEXT]).select("row", *TEXT, "n_lines", "n_removed", "n_runs",
        F.when(F.col("n_removed") == 0, F.col("text")).otherwise(left).alias("kept"))


def digest(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and the kept text's sha256 for every row; of equal rows all but one lose every line."""
    out = without_repeats(docs.select("doc_id", "text"), min_words)
    rows = out.select(F.col("row.doc_id").alias("doc_id"), "th", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))
    one = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    pick = lambda of_copy, name: F.when(F.col("nth") > 1, of_copy).otherwise(F.col(name)).alias(name)
    return one.select("doc_id", "n_lines", pick(F.col("n_lines"), "n_removed"), pick(F.lit(1).cast("long"), "n_runs"),
        pick(F.sha2(F.lit(b""), 256), "kept_sha256"))


def kept_documents(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """docs without the lines that go, and without documents of which no word is left by that."""
    out = without_repeats(docs, min_words).dropDuplicates(TEXT)
    some = out.where((F.col("n_removed") == 0) | (F.regexp_count("kept", F.lit(WORD)) > 0))
    return some.select(*(F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))

"""Quality rules: a decision list learned by sequential covering, applied as a Spark expression.

Statistics of every whole text come from one pass. Ordered rules, each a conjunction of thresholds
on them, are grown and pruned on labelled statistics; the list becomes one chain of when(). Only
the learning looks at a bounded number of labelled rows (most_rows, those with the smallest id
hash); counts and decisions cover all rows.

Defined cases: null or empty text has zero in every count and is not kept; null labels teach
nothing; with no labels the list is empty and only the base rule decides; a repeated doc_id with
several labels teaches once per pair of rows, most_rows pairs at most; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import in_slices
from .words import LINES, SPACED, bytes_of, mix, per_row, repeated, shingles, spans

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"


def text_statistics(docs: DataFrame, carried: list[str], into: str) -> DataFrame:
    """The carried columns of every row and, as one struct, the five counts of STATISTICS and n_lines of its text."""
    texts, names = docs.select(*(F.col(f"`{c}`") for c in carried), F.coalesce(F.col("text"), F.lit("")).alias("_text")), (*STATISTICS, "n_lines")

    def run(batches):
        import pyarrow as pa

        is_symbol = np.zeros(256, bool)
        is_symbol[list(SYMBOLS)] = True
        for whole in batches:
            for batch in in_slices(whole, "_text", 2 << 20):
                raw, starts = bytes_of(batch.column("_text"))
                n = batch.num_rows
                total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[starts])  # noqa: B023,E731
                words = spans(raw, starts, SPACED)
                n_words = per_row(words.row, n)
                chars = total(SPACED[raw] & ((raw & 0xC0) != 0x80))
                lines = spans(raw, starts, LINES, empty=True)
                spoken = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
                with np.errstate(over="ignore"):
                    key = lambda h, row: mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    _, later = repeated(key(lines.hash[spoken], lines.row[spoken]))
                    h, at = shingles(words, 3)
                    twice, _ = repeated(key(h, words.row[at]))
                covered = np.zeros(len(words.hash), bool)
                for k in range(3):
                    covered[at[twice] + k] = True
                out = [n_words, chars, total(is_symbol[raw]), per_row(lines.row[spoken][later], n), per_row(words.row[covered], n),
                    per_row(lines.row[spoken], n)]
                counts = pa.StructArray.from_arrays([pa.array(c) for c in out], names)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*carried, into])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1]]
    return texts.mapInArrow(run, ", ".join([*kinds, f"`{into}` struct<{', '.join(f'{c}: bigint' for c in names)}>"]))


#: What rules may ask, from the statistics alone.
FEATURES: dict[str, Column | None] = dict.fromkeys(("words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_word_share", "words_per_line"))


def feature_columns() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (F.col("n_words").cast("double"), ratio("word_chars", "n_words"), ratio("n_symbols", "n_words"),
        ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_words", "n_lines"))
    return dict(zip(FEATURES, values, strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    value: float


def _holds(x: dict[str, np.ndarray], tests) -> np.ndarray:
    ok = np.ones(len(next(iter(x.values()))), bool)
    for t in tests:
        ok &= x[t.feature] >= t.value if t.at_least else x[t.feature] < t.value
    return ok


def _merged(tests: list[Test]) -> list[Test]:
    """One test of a feature and a direction: the strictest."""
    best: dict[tuple[str, bool], Test] = {}
    for t in tests:
        old = best.get((t.feature, t.at_least))
        if old is None or (t.value > old.value) == t.at_least:
            best[t.feature, t.at_least] = t
    return list(best.values())


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 4,
    cuts: int = 64) -> list[tuple[Test, ...]]:
    """Rules that find bad rows: each grown on two thirds of the rows that no rule covers yet, pruned on the rest.

    A rule whose precision on the pruning rows is below the stated one ends the list.
    """
    rules: list[tuple[Test, ...]] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and bad[left & ~third].sum() >= 5:
        grow = {k: v[left & ~third] for k, v in x.items()}
        prune = {k: v[left & third] for k, v in x.items()}
        y, z = bad[left & ~third], bad[left & third]
        tests: list[Test] = []
        while len(tests) < most_tests:
            inside = _holds(grow, tests)
            p, n = y[inside].sum(), inside.sum()
            if p == n or not p:
                break
            best = (0.0, None)
            for name, values in grow.items():
                v, w = values[inside], y[inside]
                for cut in np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1])):
                    for at_least in (True, False):
                        m = v >= cut if at_least else v < cut
                        q = w[m].sum()
                        if q >= 3:
                            gain = q * (np.log2(q / m.sum()) - np.log2(p / n))
                            if gain > best[0] + 1e-9:
                                best = (gain, Test(name, at_least, float(cut)))
            if best[1] is None:
                break
            tests.append(best[1])

        def worth(k):
            m = _holds(prune, tests[:k])  # noqa: B023
            return (2 * z[m].sum() - m.sum()) / max(m.sum(), 1)  # noqa: B023

        if not tests:
            break
        tests = _merged(tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))])
        hit = _holds(prune, tests)
        if not hit.sum() or z[hit].mean() < precision:
            break
        rules.append(tuple(tests))
        left &= ~_holds(x, tests)
    return rules


def verdict(rules: list[tuple[Test, ...]]) -> Column:
    """The number of the first rule that rejects the row, null if none does."""
    columns, out = feature_columns(), F.lit(None).cast("int")
    for i, tests in reversed(list(enumerate(rules))):
        hit = F.lit(True)
        for t in tests:
            hit = hit & (columns[t.feature] >= t.value if t.at_least else columns[t.feature] < t.value)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> list[tuple[Test, ...]]:
    """Rules from at most most_rows labelled rows, those with the smallest hash of their id; so few ids are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    sample = known.orderBy(F.xxhash64("id"), "id", "quality").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    rows = text_statistics(texts, ["id", "quality"], "s").select("id", "quality", "s.*").select("id", "quality",
        *(c.alias(k) for k, c in feature_columns().items()))
    rows = rows.orderBy(F.xxhash64("id"), "id", "quality", *FEATURES).limit(most_rows)  # also where an id has many rows
    t = rows.toPandas()
    t = t.sort_values(list(t.columns)).sample(frac=1, random_state=0)
    return learn_rules({k: t[k].to_numpy(float) for k in FEATURES}, t["quality"].to_numpy() == 0) if len(t) else []


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (which one rejects) and kept."""
    stats = text_statistics(docs, ["doc_id"], "s").select("doc_id", "s.*")
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(fit(docs, labels)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the base rule or the list rejects."""
    into = "_s" + "_" * max(map(len, docs.columns))  # no column has this name
    rows = text_statistics(docs, docs.columns, into).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), f"{into}.*")
    kept = rows.where(~base_failed() & verdict(fit(docs, labels)).isNull())
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))

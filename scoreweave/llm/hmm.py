"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

Tokens are words, A-Z lower-cased, and one end per text. The most frequent words have a symbol each;
the others share the symbol of their count's power of two, and within it a word has the share of
its count. Words that training has not seen are one event, which takes half the mass of words seen
once. Latent states emit symbols, so a text's probability is the forward sum over all state paths
times its words' shares: over known words, the unseen event and the end, each step's probabilities
sum to one.

The corpus is coded in blocks of bounded size, each with its own word list. Word counts are
aggregates over the blocks' lists and come back to a block by joins on the word, so no list of all
words is ever in one place; only the frequent words and the symbols' parameters, whose number is
fixed, go to all tasks. Training and scoring take whole texts: long ones are walked in stretches
whose entering states and following probabilities are carried over exactly.

Defined cases: null, empty and wordless texts are the end alone; a null doc_id is in training with
the rest of fold 0; repeated rows count and are scored each; with no training tokens, every token
is unseen and has probability one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, drop_written, few_rows_at_once, written
from .encode import in_slices
from .words import SPACED, bytes_of, spans

TINY = 1e-30  # no state's share is less, so that what the future says of a state stays finite
RARE = 48  # symbols of rare words, by the power of two of their count; number 0 is the unseen event


def coded_blocks(docs: DataFrame, held_out, block_bytes: int = 4 << 20) -> DataFrame:
    """One row a block: its words (the end is the empty one) and their training counts, its texts as numbers in that list."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def block(slices):
            nonlocal number
            t = pa.Table.from_batches(slices).combine_chunks()
            raw, starts = bytes_of(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
            s = spans(raw, starts, SPACED, lower=True)
            _, first, which, n = np.unique(s.hash, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            words = [b"", *(raw[a:b].tobytes().lower() for a, b in zip(s.start[first[order]].tolist(), s.end[first[order]].tolist(), strict=True))]
            held = t.column("held_out").to_numpy().astype(bool)
            counts = np.bincount(rank[which][~held[s.row]], minlength=len(words)) if len(first) else np.zeros(1, np.int64)
            counts[0] = (~held).sum()
            ends = np.searchsorted(s.start, starts)
            ids = np.insert(rank[which].astype(np.int32) if len(first) else np.empty(0, np.int32), ends[1:], 0)
            lengths = np.diff(ends) + 1
            row = {"block": [TaskContext.get().partitionId() << 32 | number], "words": [words], "counts": [counts.astype(np.int64)],
                "doc_ids": [t.column("doc_id").to_pylist()], "held_out": [held], "lengths": [lengths], "ids": [ids.astype("<i4").tobytes()]}
            number += 1
            kinds = {"block": pa.int64(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()),
                "held_out": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(row[k], t) for k, t in kinds.items()], list(kinds))

        number, slices, size = 0, [], 0
        for whole in batches:
            for part in in_slices(whole, "text", 1 << 20):
                slices.append(part)
                size += part.get_total_buffer_size() and len(bytes_of(part.column("text"))[0])
                if size >= block_bytes:
                    yield block(slices)
                    slices, size = [], 0
        if slices:
            yield block(slices)

    return plain.mapInArrow(run, "block long, words array<binary>, counts array<long>, doc_ids array<long>, held_out array<boolean>, lengths array<long>, ids binary")


class Model:
    """Start, moves and emissions of the latent states, as probabilities."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    @classmethod
    def first(cls, states: int, weights: np.ndarray) -> Model:
        """Sticky moves and emissions near the symbols' overall shares, apart by fixed noise."""
        noise = np.random.default_rng(7).gamma(1.0, 1.0, (states, len(weights)))
        emit = (weights + 1e-9) * (0.2 + noise)
        moves = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * 0.9
        return cls(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _by_time(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Sequences from long to short, and how many of them reach each time."""
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right").tolist()


def _from_logs(v: np.ndarray) -> np.ndarray:
    """Columns of logarithms as shares, however small they are."""
    v = np.exp(v - v.max(0))
    return v / v.sum(0)


class _Stretches:
    """Sequences as stretches of at most `most` time steps, with what is carried over their borders.

    The states after a sequence's first stretch follow from the start, what its last stretch gives each
    state before it from the end. A stretch between has a transfer matrix, the product of its steps'
    moves and emissions, whose rows are scaled at every step and keep their scales as logarithms. From
    these come the states in which each stretch is entered and what follows it, so all stretches are
    walked side by side and the result is that of the whole sequences. Arrays have a row a state.
    """

    def __init__(self, m: Model, symbols: np.ndarray, lengths: np.ndarray, most: int, kind):
        parts = -(-lengths // most)
        self.nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.begin = np.repeat(np.cumsum(lengths) - lengths, parts) + self.nth * most
        self.size = np.minimum(most, np.repeat(lengths, parts) - self.nth * most)
        self.of, self.left = np.repeat(np.arange(len(lengths)), parts), np.repeat(parts, parts) - self.nth  # left: this one and those after it
        self.symbols, self.start, self.moves, self.k = symbols, m.start.astype(kind), m.moves.astype(kind), len(m.start)
        top = m.emit.max(0)
        self.emit = np.ascontiguousarray((m.emit / np.where(top > 0, top, 1)).astype(kind))  # a factor a symbol is of no account here
        self.entered, self.follows = np.repeat(self.start[:, None], len(self.nth), 1), np.ones((self.k, len(self.nth)), kind)
        if (parts > 1).any():
            self._carry()

    def _carry(self) -> None:
        with np.errstate(divide="ignore"):
            first, last = np.flatnonzero((self.nth == 0) & (self.left > 1)), np.flatnonzero((self.nth > 0) & (self.left == 1))
            between = np.flatnonzero((self.nth > 0) & (self.left > 1))
            after, before = np.log(self._after(first)), np.log(self._before(last))
            transfer, scale, place = *self._transfers(between), np.zeros(len(self.nth), np.int64)
            place[between] = np.arange(len(between))
            self.entered[:, first + 1] = np.exp(after)
            self.follows[:, last - 1] = np.exp(before)
            for j in range(1, int(self.nth.max())):  # the stretches number j that have another after them, and those number j from the end
                rows = between[self.nth[between] == j]
                v = np.log(self.entered[:, rows].astype(np.float64)) + scale[:, place[rows]]
                self.entered[:, rows + 1] = _from_logs(np.log(np.einsum("kn,lkn->ln", _from_logs(v), transfer[:, :, place[rows]])))
                rows = between[self.left[between] == j + 1]
                v = np.log(np.einsum("lkn,ln->kn", transfer[:, :, place[rows]], self.follows[:, rows].astype(np.float64))) + scale[:, place[rows]]
                self.follows[:, rows - 1] = _from_logs(v)

    def _emitted(self, rows: np.ndarray, t: int) -> np.ndarray:
        return self.emit.take(self.symbols[self.begin[rows] + t], 1)

    def _after(self, rows: np.ndarray) -> np.ndarray:
        """Shares of the states at the end of first stretches."""
        v = np.repeat(self.start[:, None], len(rows), 1)
        for t in range(int(self.size[rows].max(initial=0))):
            v = (v if t == 0 else self.moves.T @ v) * self._emitted(rows, t)
            v /= v.sum(0)
            np.maximum(v, TINY, out=v)
        return v

    def _before(self, rows: np.ndarray) -> np.ndarray:
        """What last stretches give each state of the step before them, up to a factor."""
        order, active = _by_time(self.size[rows])
        v = np.ones((self.k, len(rows)), self.moves.dtype)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            w = self.moves @ (v[:, :n] * self._emitted(rows[order[:n]], t))
            v[:, :n] = np.maximum(w / w.sum(0), TINY)
        back = np.empty_like(v)
        back[:, order] = v
        return back

    def _transfers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transfer matrices (to, from, stretch) of stretches of full size and the logarithms of their rows' scales (from, stretch)."""
        k, n = self.k, len(rows)
        x = np.repeat(self.moves.T[:, :, None], n, 2)
        logs, product = np.zeros((k, n)), np.ones((k, n))
        for t in range(int(self.size[rows].max(initial=0))):
            if t:
                x = (self.moves.T @ x.reshape(k, k * n)).reshape(k, k, n)
            x *= self._emitted(rows, t)[:, None, :]
            scale = x.sum(0)
            x /= scale
            np.maximum(x, TINY, out=x)
            product *= scale
            if t % 4 == 3:
                logs += np.log(product)
                product[:] = 1
        return x, logs + np.log(product)


def forward(m: Model, symbols: np.ndarray, lengths: np.ndarray, most: int = 1024) -> np.ndarray:
    """log10 probability of each sequence of symbols; sequences lie one after another."""
    s = _Stretches(m, symbols, lengths, most, np.float64)
    order, active = _by_time(s.size)
    at, out, product = s.begin[order], np.zeros(len(order)), np.ones(len(order))
    alpha, emit = np.where(s.nth == 0, s.start[:, None], s.moves.T @ s.entered)[:, order], np.ascontiguousarray(m.emit)
    for t, n in enumerate(active):
        alpha = (alpha[:, :n] if t == 0 else s.moves.T @ alpha[:, :n]) * emit.take(symbols[at[:n] + t], 1)
        scale = alpha.sum(0)
        alpha /= scale
        product[:n] *= scale
        if t % 4 == 3:
            out += np.log10(product)
            product[:] = 1
    return np.bincount(s.of[order], out + np.log10(product), len(lengths))


def expected_counts(m: Model, symbols: np.ndarray, lengths: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions over the whole sequences."""
    k, n_symbols = m.emit.shape
    s = _Stretches(m, symbols, lengths, most, np.float32)
    order, active = _by_time(s.size)
    first, entered, follows = (s.nth == 0)[order], s.entered[:, order], s.follows[:, order]
    # Tokens by time step: those of step t lie from at[t] on, in the order of the stretches.
    at, rank = np.cumsum([0, *active]), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    step = np.arange(len(symbols)) - np.repeat(s.begin, s.size)
    place = at[step] + np.repeat(rank, s.size)
    by_time = np.empty_like(symbols)
    by_time[place] = symbols
    states = s.emit.take(by_time, 1)  # emissions, then what the past says of each step's states, then the past and the future
    parts = [states[:, a : a + n] for a, n in zip(at.tolist(), active, strict=False)]
    for t, now in enumerate(parts):
        now *= np.where(first, s.start[:, None], s.moves.T @ entered) if t == 0 else s.moves.T @ parts[t - 1][:, : now.shape[1]]
        now /= now.sum(0)
        np.maximum(now, TINY, out=now)
    steps, back = np.zeros((k, k)), np.ones((k, 0), np.float32)
    for t in range(len(active) - 1, -1, -1):
        now, held = parts[t], back.shape[1]
        beta = follows[:, : active[t]].copy()  # stretches that end here: what follows, up to a factor
        beta[:, :held] = s.moves @ back
        both = now * beta
        scale = both.sum(0)
        if held:
            steps += now[:, :held] @ (back / scale[:held]).T
        np.divide(both, scale, out=now)
        beta /= scale
        back = s.emit.take(by_time[at[t] : at[t + 1]], 1) * beta
    later = np.flatnonzero(~first)
    if len(later):
        into = back[:, later]
        steps += entered[:, later] @ (into / (entered[:, later] * (s.moves @ into)).sum(0)).T
    emitted = np.stack([np.bincount(by_time, g, n_symbols) for g in states]) if len(symbols) else np.zeros((k, n_symbols))
    starts = states[:, place[np.cumsum(lengths) - lengths]].sum(1, dtype=np.float64) if len(lengths) else np.zeros(k)
    return starts, steps * m.moves, emitted


def _together(batches, columns, most_tokens: int = 1_250_000):
    """Symbols and lengths of some blocks' texts, of most_tokens or few more, and the blocks' other columns: long arrays waste less on each step."""
    held, tokens = [], 0

    def given():
        return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held]

    for batch in batches:
        for i in range(batch.num_rows):
            symbols = np.frombuffer(batch.column("symbols")[i].as_buffer(), "<u2")
            held.append((symbols, batch.column("lengths")[i].values.to_numpy(), {c: batch.column(c)[i].values for c in columns}))
            tokens += len(symbols)
            if tokens >= most_tokens:
                yield given()
                held, tokens = [], 0
    if held:
        yield given()


def train(coded: DataFrame, weights: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch rounds over all training texts; each round's counts are a Spark aggregate of fixed size."""
    spark, m, n = coded.sparkSession, Model.first(states, weights), len(weights)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(m)

        def run(batches, sent=sent):
            import pyarrow as pa

            total = None
            for symbols, lengths, rows in _together(batches, ("held_out",)):
                held = np.concatenate([r["held_out"].to_numpy(zero_copy_only=False) for r in rows])
                if not held.all():
                    counts = np.concatenate([c.ravel() for c in expected_counts(sent.value, symbols[~np.repeat(held, lengths)], lengths[~held])])
                    total = counts if total is None else total + counts
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

        sums = coded.select("lengths", "held_out", "symbols").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(states + states * states + states * n)
        total[sums["at"].to_numpy()] = sums["n"].to_numpy()
        if not np.isfinite(total).all():
            raise ArithmeticError("expected counts that are not finite")
        start, moves, emit = total[:states] + 1e-3, total[states : states + states**2].reshape(states,
            states) + 1e-3, total[states + states**2 :].reshape(states, n)
        emit = emit + 0.5 * weights  # no state gives a symbol that is in use no mass
        m = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        sent.unpersist()
    return m


def scores(docs: DataFrame, held_out_of, frequent: int = 4096, states: int = 8, rounds: int = 5, longest: int = 256) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    held_out_of: Column -> Column, whether an id stays out of training. The `frequent` most frequent
    words of at most `longest` bytes have symbols of their own, so that their table has a bounded size.
    """
    if RARE + 1 + frequent > 1 << 16:
        raise ValueError("symbols are 16-bit numbers: frequent is too large")
    spark = docs.sparkSession
    blocks = written(coded_blocks(docs, held_out_of(F.col("doc_id"))), "coded-blocks")
    with few_rows_at_once(spark):  # a row is a block of some megabytes; a large file or partition holds a hundred
        return _scores_of(blocks, frequent, states, rounds, longest)


def _scores_of(blocks: DataFrame, frequent: int, states: int, rounds: int, longest: int) -> DataFrame:
    spark = blocks.sparkSession
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("block", "local",
        F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = written(listed.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "word-counts")
    n_train, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()

    # Symbols: RARE classes, the end, the frequent words. P(word | class) is count / class total.
    words = counts.where(F.length("word") > 0)
    top = [(bytes(r[0]), r[1]) for r in words.where(F.length("word") <= longest).orderBy(F.desc("c"), "word").limit(frequent).collect()]
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    own = {b"": (ends, RARE)} | {w: (c, RARE + 1 + i) for i, (w, c) in enumerate(top)}
    named = spark.createDataFrame([(w, *v) for w, v in own.items()], "word binary, c long, symbol int")
    weights, class_total = np.zeros(RARE + 1 + len(top)), np.ones(RARE + 1 + len(top))
    for c, symbol in own.values():
        weights[symbol] = class_total[symbol] = c
    power = F.least(F.length(F.bin("c")), F.lit(RARE - 1)).alias("symbol")
    rare = counts.join(F.broadcast(named.select("word")), "word", "left_anti").select("word", "c", power)
    for r in rare.groupBy("symbol").agg(F.sum("c").alias("c")).collect():
        weights[r["symbol"]] = class_total[r["symbol"]] = r["c"]

    # A frequent word stands in nearly every block: those meet a table of bounded size, only the others are joined by shuffle.
    listed = listed.select("block", "local", "word")
    often = listed.join(F.broadcast(named), "word").select("block", "local", "c", "symbol")
    others = listed.join(F.broadcast(named.select("word")), "word", "left_anti").join(rare, "word").select("block", "local", "c", "symbol")
    back = written(often.union(others).groupBy("block").agg(F.collect_list(F.struct("local", "c", "symbol")).alias("known")), "block-words")
    paired = blocks.select("block", "doc_ids", "held_out", "lengths", "ids", F.size("words").alias("n_words")).join(back, "block", "left")
    base, shares = np.log10(n_train + n_words + 1), class_total

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i4")
                lengths = batch.column("lengths")[i].values.to_numpy()
                n = batch.column("n_words")[i].as_py()
                c, symbol = np.zeros(n, np.int64), np.zeros(n, np.int64)
                known = batch.column("known")[i].values
                if known is not None:
                    local = known.field("local").to_numpy()
                    c[local], symbol[local] = known.field("c").to_numpy(), known.field("symbol").to_numpy()
                at = np.cumsum(lengths) - lengths
                share = np.where(c > 0, np.log10(np.maximum(c, 1) / shares[symbol]), 0.0)
                sums = [np.add.reduceat(x[ids], at) for x in (np.log10(c + 1) - base, share, (c > 0).astype(np.int64))]
                row = {"doc_ids": batch.column("doc_ids")[i].values, "held_out": batch.column("held_out")[i].values, "lengths": lengths,
                    "base": sums[0], "share": sums[1], "known": sums[2]}
                cols = [pa.ListArray.from_arrays([0, len(lengths)], v if isinstance(v, pa.Array) else pa.array(v)) for v in row.values()]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([symbol[ids].astype("<u2").tobytes()], pa.binary())], [*row, "symbols"])

    coded = written(paired.mapInArrow(code,
        "doc_ids array<long>, held_out array<boolean>, lengths array<long>, base array<double>, share array<double>, known array<long>, symbols binary"),
        "coded-texts")
    for done in (blocks, back, counts):
        drop_written(done)
    m = train(coded, weights / max(weights.sum(), 1), states, rounds) if n_train else Model(np.ones(1), np.ones((1, 1)), np.ones((1, len(weights))))
    if n_train:
        half = m.emit[:, 1] / 2
        m.emit[:, 0] += half
        m.emit[:, 1] -= half
        m.emit[:, 0] += 1e-12
        m.emit /= m.emit.sum(1, keepdims=True)
    sent = spark.sparkContext.broadcast(m)

    def score(batches):
        import pyarrow as pa

        for symbols, lengths, rows in _together(batches, ("doc_ids", "held_out", "known", "base", "share")):
            get = lambda name: pa.concat_arrays([r[name] for r in rows])  # noqa: B023,E731
            logs = forward(sent.value, symbols, lengths) + get("share").to_numpy()
            if not np.isfinite(logs).all():
                raise ArithmeticError("a score that is not finite")
            yield pa.RecordBatch.from_arrays([get("doc_ids"), get("held_out"), pa.array(lengths), get("known"),
                pa.array(np.full(len(lengths), n_train, np.int64)), get("base"), pa.array(logs)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = written(coded.mapInArrow(score, kind), "text-scores")
    drop_written(coded)
    return out


def fold_is(n: int, fold: int):
    """held_out_of for scores: ids whose crc32 as text leaves `fold` modulo n."""
    return lambda col: crc32_mod(col, n) == fold

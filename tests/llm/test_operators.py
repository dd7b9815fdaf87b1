"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import attribution, decontam, factors, hmm, lines, neighbours, packing, rules, simhash, wavelet
from scoreweave.llm.encode import encoder
from scoreweave.llm.vocabularies import byte_bpe, byte_bpe_pattern, word_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, sequence_id string, words int"


def corpus():
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefghéçñ", k=random.randint(1, 7))) for _ in range(150)]
    sentence = lambda n: " ".join(random.choices(vocabulary, k=n))
    passage = sentence(60) + ".\n" + sentence(12) + "."
    texts = [sentence(random.randint(1, 90)) + random.choice([".", "!\n", "\n\n"]) + sentence(random.randint(0, 40)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " fim", passage + "\n" + sentence(5), sentence(7) + "\n" + passage, "Aa" * 300,
        "so so so " * 80, "", None, "   \n\t ", "%%% *** &&&", sentence(3000)]
    rows = [(i, t, None, "s", 1, "x", "y", 3) for i, t in enumerate(texts)]
    return [*rows, (None, sentence(30), None, None, None, None, None, None), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def known():
    return [(r[0], r[1] or "") for r in corpus()]


def test_ids_equal_the_library(docs):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    texts = [x for _, x in known()] + ["a<|endoftext|>b", "<|startoftext|>A <|ENDOFTEXT|> é<|endoftext|><|endoftext|>",
        "don't 've'S ×,÷.é,«a»… x　Z 12a3b É.Ñ'T 😀!!a", "it's!'s 'S,'s a_b-c__d éà'll"]
    ids, at = encoder(word_bpe()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_files_are_encoded_whole(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    said = json.loads(Tokenizer.from_file(word_bpe()).to_str())
    said["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "cased.json")
    Tokenizer.from_str(json.dumps(said)).save(path)
    texts = ["Upper and lower CASE", "", "a<|endoftext|>B"]
    ids, at = encoder(path).encode(pa.array(texts))
    t = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    rows = packing.pack_documents(docs, word_bpe(), 64).collect()
    want = Counter()
    for d, text in known():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.update((d, i // 64, i, len(ids[i : i + 64]), zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    bound = math.ceil(sum(r["length"] for r in rows) / 64)
    assert bound <= len(by) <= 1.05 * bound + 1
    assert packing.pack_documents(none, word_bpe()).count() == 0


def test_sum_of_squares_is_least():
    lengths = np.array([5, 3, 3, 2, 2, 2, 1, 4, 6])
    bins, offsets = packing.sum_of_squares(lengths, 8)
    gaps, used = Counter(), {}
    for i in np.argsort(-lengths, kind="stable"):
        s, square = lengths[i], lambda c: sum(n * n for g, n in c.items() if g)
        options = {}
        for gap in {*(8 - u for u in used.values()), 8}:
            if gap >= s:
                after = gaps.copy()
                after[gap] -= gap != 8
                after[gap - s] += 1
                options[gap] = square(after)
        gap = 8 - used.get(bins[i], 0)
        assert options[gap] == min(options.values())
        gaps[gap] -= gap != 8
        gaps[gap - s] += 1
        assert offsets[i] == used.get(bins[i], 0)
        used[bins[i]] = used.get(bins[i], 0) + s


def brute_fp(text):
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    count = [sum(xxh64_intdigest(s, 42) >> k & 1 for s in sh) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * count[k] > len(sh))


def test_simhash(docs, none):
    got = simhash.near_groups(docs, 2, 3).collect()
    fps = {t: brute_fp(t) for _, t in known()}
    by_id = dict(known())
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}
    for _ in distinct:
        for a in distinct:
            for b in distinct:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    low = {}
    for d, t in known():
        if d is not None:
            low[root[fps[t]]] = min(d, low.get(root[fps[t]], d))
    assert len(got) == len(known())
    for r in got:
        f = fps[by_id[r["doc_id"]]]
        assert r["fp"] % (1 << 64) == f and r["component_id"] == low.get(root[f])
    one = simhash.one_per_group(docs)
    assert one.columns == docs.columns and one.count() == len(set(root[f] for f in fps.values()))
    assert simhash.near_groups(none).count() == 0


def test_tiles_find_every_link(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 3))) for b in base for _ in range(4)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for tile in (4096, 2):
        got = simhash.links_within(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, tile).collect()
        root = {f: f for f in signed}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in got:
            assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2
            root[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
        for a in signed:
            for b in signed:
                if ((a ^ b) % (1 << 64)).bit_count() <= 2:
                    assert top(a) == top(b)


def plain_model(texts, frequent, states, rounds):
    """Word counts, log10 share and symbol of a word, and the model, by Baum-Welch one text and one step at a time."""
    c = Counter(w for t in texts for w in t)
    top = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w))[:frequent]
    symbol = {w: hmm.RARE + 1 + top.index(w) if w in top else hmm.RARE if w is None else c[w].bit_length() for w in c}
    weights = np.zeros(hmm.RARE + 1 + len(top))
    for w, n in c.items():
        weights[symbol[w]] += n
    m = hmm.Model.first(states, weights / weights.sum())
    for _ in range(rounds):
        start, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(weights)))
        for t in texts:
            x = [symbol[w] for w in t]
            alphas, scales = [], []
            for i, s in enumerate(x):
                a = (m.start if i == 0 else alphas[-1] @ m.moves) * m.emit[:, s]
                scales.append(a.sum())
                alphas.append(a / a.sum())
            beta = np.ones(states)
            for i in range(len(x) - 1, -1, -1):
                emit[:, x[i]] += alphas[i] * beta
                if i == 0:
                    start += alphas[0] * beta
                else:
                    ahead = m.emit[:, x[i]] * beta / scales[i]
                    moves += alphas[i - 1][:, None] * m.moves * ahead
                    beta = m.moves @ ahead
        start, moves, emit = start + 1e-3, moves + 1e-3, emit + 0.5 * weights / weights.sum()
        m = hmm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    half = m.emit[:, 1] / 2  # words not seen take half the mass of words seen once
    m.emit[:, 0] += half + 1e-12
    m.emit[:, 1] -= half
    m.emit /= m.emit.sum(1, keepdims=True)
    return c, {w: math.log10(n / weights[symbol[w]]) for w, n in c.items()}, symbol, m


def test_hmm_scores(docs, none):
    got = {r["doc_id"]: r for r in hmm.scores(docs, hmm.fold_is(7, 2), frequent=50, states=3, rounds=2).collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*t.encode().lower().split(), None]
    c, share, symbol, m = plain_model([tokens(t) for d, t in known() if not held(d)], 50, 3, 2)
    n, v = sum(c.values()), len(c)
    for d, t in known():
        r, w = got[d], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        log, a = 0.0, m.start
        for i, x in enumerate(w):
            a = (a if i == 0 else a @ m.moves) * m.emit[:, symbol.get(x, 0)]
            log += math.log10(a.sum()) + share.get(x, 0.0)
            a = a / a.sum()
        assert math.isclose(r["score"], log, rel_tol=1e-4)
    assert hmm.scores(none, hmm.fold_is(7, 2)).count() == 0


def test_stretches_carry_whole_sequences():
    rng = np.random.default_rng(3)
    m = hmm.Model.first(4, rng.dirichlet(np.ones(9)))
    lengths = np.array([3, 1, 40, 17, 100, 2])
    symbols = rng.integers(0, 9, lengths.sum())
    whole = hmm.expected_counts(m, symbols, lengths, 1000)
    for most in (1, 3, 7, 10):
        assert np.allclose(hmm.forward(m, symbols, lengths, most), hmm.forward(m, symbols, lengths, 1000), rtol=1e-12)
        for a, b in zip(hmm.expected_counts(m, symbols, lengths, most), whole):
            assert np.allclose(a, b, atol=1e-4)


@pytest.mark.parametrize("off", [1e-4, 1e-6, 1e-8, 1e-12])
@pytest.mark.filterwarnings("error")
def test_sharp_models_stay_finite(off):
    """States that hardly move and hardly share symbols, and a symbol that no state has: as in plain 64-bit steps over the whole text."""
    k, n = 3, 3200
    sharp = (np.full((k, k), off) + np.eye(k)) / (1 + k * off)
    emit = np.concatenate([sharp, np.zeros((k, 1))], 1)
    m = hmm.Model(np.array([1 - 2 * off, off, off]), sharp, emit)
    rng = np.random.default_rng(5)
    symbols = np.concatenate([np.repeat(rng.integers(0, k, n // 100), 100), rng.integers(0, k, n), [0], np.repeat([2, 1, 0], 700)])
    lengths = np.array([n, n, 1, 2100])
    counts = hmm.expected_counts(m, symbols, lengths)
    steps, emitted, starts, at = np.zeros((k, k)), np.zeros((k, k + 1)), np.zeros(k), 0
    for size, log in zip(lengths, hmm.forward(m, symbols, lengths), strict=True):
        x = symbols[at : at + size]
        a, b, scale = np.zeros((size, k)), np.ones((size, k)), np.zeros(size)
        for t in range(size):
            a[t] = (m.start if t == 0 else a[t - 1] @ m.moves) * m.emit[:, x[t]]
            scale[t] = a[t].sum()
            a[t] /= scale[t]
        assert math.isclose(log, np.log10(scale).sum(), rel_tol=1e-9)
        for t in range(size - 1, 0, -1):
            b[t - 1] = m.moves @ (m.emit[:, x[t]] * b[t]) / scale[t]
            steps += np.outer(a[t - 1], m.emit[:, x[t]] * b[t] / scale[t]) * m.moves
        np.add.at(emitted.T, x, a * b)
        starts += a[0] * b[0]
        at += size
    for got, want in zip(counts, (starts, steps, emitted), strict=True):
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-3, atol=1e-2)


def test_forward_is_exact_and_training_climbs():
    rng = np.random.default_rng(1)
    m = hmm.Model.first(3, rng.dirichlet(np.ones(5)))
    lengths = np.array([3, 1, 4])
    symbols = rng.integers(0, 5, lengths.sum())
    at = 0
    for length, log in zip(lengths, hmm.forward(m, symbols, lengths, 2)):
        total = 0.0
        for path in np.ndindex(*[3] * length):
            p = m.start[path[0]] * m.emit[path[0], symbols[at]]
            for i in range(1, length):
                p *= m.moves[path[i - 1], path[i]] * m.emit[path[i], symbols[at + i]]
            total += p
        assert math.isclose(log, math.log10(total), rel_tol=1e-9)
        at += length
    lengths = np.full(40, 12)
    symbols = np.concatenate([rng.choice(5, 12, p=p) for p in rng.dirichlet(np.ones(5) * 0.3, 40)])
    last = -np.inf
    for _ in range(5):
        now = hmm.forward(m, symbols, lengths).sum()
        assert now >= last - 1e-4
        last = now
        s, t, e = hmm.expected_counts(m, symbols, lengths, 5)
        assert math.isclose(e.sum(), lengths.sum(), rel_tol=1e-3)
        m = hmm.Model(s / s.sum(), t / t.sum(1, keepdims=True), e / e.sum(1, keepdims=True))


def test_decontamination(spark, docs, none):
    by = dict(known())
    items = spark.createDataFrame([(1, " ".join(by[71].split()[100:112]).encode().upper().decode() + "!"),
        (2, "nada disso está em texto algum daqui hoje"), (3, None), (4, ""), (5, " ".join(by[7].split()[:3])),
        (6, " ".join(by[71].split()[500:540]))], "item_id long, text string")

    def brute(text, item):
        q, d = decontam.shingle_set((item or "").encode(), 5), decontam.shingle_set(text.encode(), 5)
        return len(q & d) / len(q) if q else 0

    want = Counter((d, i) for d, t in known() for i, x in items.collect() if brute(t, x) >= 0.8)
    for block in (150, 1 << 20):
        got = decontam.contained_items(docs, items, block_bytes=block).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in got) == want and len(want) >= 2
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(known()) - sum(1 for d, t in known() if any(brute(t, x) >= 0.8 for _, x in items.collect()))
    assert decontam.contained_items(none, items).count() == 0 and decontam.contained_items(docs, items.limit(0)).count() == 0


def test_sketches_find_contained_items(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(20_000)]
    items = [(i, rng.choices(words, k=rng.randint(6, 120))) for i in range(3000)]
    docs, planted = [], 0
    for d in range(400):
        text = rng.choices(words, k=rng.choice((100, 1000, 8000)))
        for _ in range(6):
            own = list(rng.choice(items)[1])
            if rng.random() < 0.5 and len(own) > 60:
                own[rng.randrange(len(own))] = "x"  # five shingles or fewer go
            at = rng.randrange(len(text))
            text[at:at] = own
        docs.append((d, " ".join(text)))
    sets = {i: decontam.shingle_set(" ".join(w).encode(), 5) for i, w in items}
    by_shingle = {}
    for i, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    want = set()
    for d, text in docs:
        n = Counter(i for s in decontam.shingle_set(text.encode(), 5) for i in by_shingle.get(s, ()))
        want |= {(d, i) for i, c in n.items() if c >= 0.8 * len(sets[i]) - 1e-9}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(spark.createDataFrame(docs,
        "doc_id long, text string").repartition(4), table).collect()}
    assert len(want) > 2000 and got <= want and len(got) >= 0.999 * len(want)


def test_sketches_keep_the_stated_share():
    rng = np.random.default_rng(5)
    for n in (64, 127, 1000, 1023, 1024, 30_000):
        h = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        kept = decontam.sketch(h, np.zeros(n, np.int64), np.array([n])).mean()
        assert 0.8 * decontam.KEPT < kept < 0.75
    assert decontam.least_shown(np.array([5, 20, 21, 200]), 0.8).tolist() == [0, 0, 1, 42]


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(20)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    for r in rules.judge(docs, labels).collect():
        t = dict(known())[r["doc_id"]]
        w = t.encode().split()
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        said = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(said) - len(set(said)), len(covered))
        assert tuple(r[c] for c in rules.STATISTICS) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == rules.judge(docs, labels).where("kept").count()
    assert rules.judge(none, labels).count() == 0 and rules.judge(docs, labels.limit(0)).count() == len(known())


def test_verdict_is_the_first_rule_that_holds(docs):
    t = rules.Test
    listed = [(t("words", True, 80.0), t("symbols_per_word", False, 0.1)), (t("mean_word_chars", True, 4.5),),
        (t("dup_line_share", True, 0.2), t("words_per_line", False, 30.0))]
    stats = rules.text_statistics(docs, ["doc_id"], "s").select("doc_id", "s.*").withColumn("rule", rules.verdict(listed))
    seen = set()
    for r in stats.collect():
        per = lambda a, b: r[a] / max(r[b], 1)  # noqa: B023,E731
        x = {"words": r["n_words"], "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"), "words_per_line": per("n_words", "n_lines")}
        want = next((i for i, tests in enumerate(listed) if all(x[q.feature] >= q.value if q.at_least else x[q.feature] < q.value for q in tests)), None)
        assert r["rule"] == want
        seen.add(want)
    assert {0, 1, None} <= seen
    assert rules._merged([t("words", False, 9.0), t("words", True, 2.0), t("words", False, 7.0)]) == [t("words", False, 7.0), t("words", True, 2.0)]


def test_rules_are_learned():
    rng = np.random.default_rng(2)
    x = {k: rng.random(3000) for k in rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) | ((x["mean_word_chars"] < 0.3) & (x["dup_line_share"] > 0.5))
    found = rules.learn_rules(x, bad)
    hit = np.any([rules._holds(x, r) for r in found], axis=0)
    assert len(found) >= 2 and (hit & bad).sum() / bad.sum() > 0.9 and (hit & ~bad).sum() / hit.sum() < 0.1
    assert rules.learn_rules(x, np.zeros(3000, bool)) == []


def test_wavelet_round_trip(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    got = wavelet.round_trip(docs, word_bpe(), 2).collect()
    ids = lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert own == ids(dict(known())[r["doc_id"]]) and r["n_tokens"] == len(own) and r["start"] == start
        start += len(own)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((d for d, _ in known()), key=lambda d: (d is not None, d or 0))
    assert wavelet.round_trip(none, word_bpe()).count() == 0


def test_wavelet_rank_and_select():
    rng = np.random.default_rng(4)
    for n in (1, 511, 512, 65_536, 140_000):
        x = rng.integers(0, 37, n).astype(np.uint16)
        w = wavelet.WaveletMatrix(wavelet.build(np.array([5]), np.array([n]), x, 6))
        assert w.tokens().tolist() == x.tolist()
        for i in rng.integers(0, n, 20).tolist():
            assert w.access(i) == x[i]
        for token in (0, 7, 36, 50):
            at = np.flatnonzero(x == token)
            assert w.count(token) == len(at) and w.rank(token, n // 2) == (at < n // 2).sum()
            some = range(0, len(at), -(-len(at) // 300) or 1)
            assert [w.select(token, k) for k in some] == at[some].tolist()
    with pytest.raises(ValueError):
        wavelet.build(np.array([1]), np.array([1]), np.array([64], np.uint16), 6)


def test_attribution(spark, docs, none):
    encoding, _ = attribution._encoding(byte_bpe(), byte_bpe_pattern())
    size = 7
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.char_length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)), F.lit(size)),
        lambda a: F.struct(a.cast("string").alias("name"), a.cast("long").alias("begin"), (a + size).cast("long").alias("end")))
    got = {}
    for r in attribution.token_counts(docs.dropDuplicates(["doc_id"]).withColumn("s", cut), byte_bpe(), byte_bpe_pattern(), "s").collect():
        got.setdefault(r["doc_id"], Counter())[r["section"]] += r["n_tokens"]
    for d, text in dict(known()).items():
        want, at = Counter(), 0
        bounds = [len(text[:i].encode()) for i in range(0, len(text) + size, size)]
        for token in encoding.encode_ordinary(text):
            n = len(encoding.decode_single_token_bytes(token))
            held = [max(0, min(b, at + n) - max(a, at)) for a, b in zip(bounds, [*bounds[1:], 1 << 40])]
            want[str(held.index(max(held)) * size)] += 1
            at += n
        assert {k: v for k, v in got[d].items() if v} == dict(want)
    rows = [(1, "abcdef ghi" * 2000, [("b", 5, 9_000), None, ("a", 0, 6), ("n", None, 4), ("m", 3, None), ("e", 30_000, 40_000),
        ("v", 7, 3)]), (2, "x y", None), (None, None, [("a", 0, 5)])]
    odd = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<name: string, begin: bigint, end: bigint>>")
    out = {(r["doc_id"], r["section"], r["n_chars"]): r["n_tokens"] for r in attribution.token_counts(odd, byte_bpe(), byte_bpe_pattern(), "s").collect()}
    assert set(out) == {(1, "a", 6), (1, "b", 8994), (1, None, 0), (1, "n", 0), (1, "m", 0), (1, "e", 0), (1, "v", 0), (2, None, 0), (None, "a", 0)}
    assert out[2, None, 0] == len(encoding.encode_ordinary("x y")) and out[1, "b", 8994] > 1000 and out[1, "n", 0] == out[1, "e", 0] == out[1, "v", 0] == 0
    lines_ = attribution.token_counts(docs, byte_bpe(), byte_bpe_pattern())
    assert lines_.agg(F.sum("n_tokens")).head()[0] == sum(len(encoding.encode_ordinary(t)) for _, t in known())
    assert attribution.token_counts(none, byte_bpe(), byte_bpe_pattern()).count() == 0


def test_neighbours(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(50)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = neighbours.scores(docs, labels, neighbours.fold_is(5, 0)).collect()
    assert len(out) == len(known()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert {r["doc_id"] for r in out if r["held_out"]} == {d for d, _ in known() if d is None or zlib.crc32(str(d).encode()) % 5 == 0}
    assert all(r["score"] == 0.5 for r in neighbours.scores(docs, labels.limit(0), neighbours.fold_is(5, 0)).collect())
    assert neighbours.scores(none, labels, neighbours.fold_is(5, 0)).count() == 0


def plain_terms(text):
    """The term counts of one text, square-rooted, of length one."""
    b = text.encode()
    out = np.zeros(neighbours.BUCKETS + neighbours.COUNTS)
    for x, y in zip(b, b[1:]):
        out[neighbours._PAIR[x << 8 | y]] += 1
    w = b.split()
    three = Counter(zip(w, w[1:], w[2:]))
    twice = sum(n for n in three.values() if n > 1)
    signs = sum(33 <= c <= 126 and not chr(c).isalnum() for c in b)
    out[neighbours.BUCKETS :] = [8 * n for n in (len(w), sum(x == y for x, y in zip(w, w[1:])), twice, signs, text.count("\n") + 1, sum(c > 127 for c in b))]
    return np.sqrt(out) / max(np.sqrt(out.sum()), 1e-9)


def test_terms_and_frequencies(docs):
    import pyarrow as pa

    from scoreweave.llm.words import bytes_of

    texts = [t for _, t in known()]
    x = neighbours.terms(*bytes_of(pa.array(texts)))
    want = np.stack([plain_terms(t) for t in texts])
    assert np.allclose(x, want, atol=1e-5)
    assert np.allclose(neighbours.inverse_frequencies(docs), np.log((1 + len(texts)) / (1 + (want > 0).sum(0))) + 1)


def test_votes_are_exact():
    rng = np.random.default_rng(6)
    x = rng.random((80, 20)).astype(np.float32)
    space = neighbours.Space.fit(x, np.arange(80) % 2, 8, np.ones(20))
    y = rng.random((30, 20)).astype(np.float32)
    got = space.score(y, 5, 2.0, block=7)
    v = y @ space.project
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for row, score in zip(v, got):
        cosine = space.vectors @ row
        near = np.argsort(-cosine)[:5]
        w = np.maximum(cosine[near], 0).astype(float) ** 2
        assert math.isclose(score, (w * (near % 2)).sum() / w.sum(), rel_tol=1e-4)


@pytest.mark.parametrize("most_runs", [1024, 1])
def test_longest_previous_factors(docs, none, most_runs):
    length, seen, want = 20, set(), []
    order = sorted(range(len(known())), key=lambda i: (known()[i][0] is not None, known()[i][0] or 0))
    for i in order:
        b = known()[i][1].encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            if s in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        want.append((known()[i][0], len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    if most_runs == 1024:
        assert Counter(map(tuple, factors.digest(docs, length, 8).collect())) == Counter(want)
    else:
        kept = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in factors.remove_repeats(docs, length, 8, most_runs).collect()}
        assert all(kept[d] == h for d, _, _, _, h in want if d != 3)
    assert factors.digest(none).count() == 0


def test_hot_passages_by_longer_windows(spark, monkeypatch):
    """A passage between ever other words, shorter and longer than a string: right bytes, and no row per string."""
    rng, length, most = random.Random(12), 40, 30
    noise = lambda: "".join(rng.choices("abcdefgh ", k=rng.randint(30, 60)))
    short, long = noise()[:30], noise() + noise()
    rows = [(i, noise() + (short if i % 3 else long) + noise() + (noise()[:9] + short if i % 5 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for d, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if t[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(t[j : j + length])
        want[d] = "".join(c for c, g in zip(t, gone) if not g)
    made, cut = [], factors._longer_windows
    strings = F.sum(F.col("place").bitwiseAND(1023))

    def counted(keyed, stretches, length, k):
        out = cut(keyed, stretches, length, k)
        made.append((k, out.count(), stretches.agg(strings).head()[0]))
        return out

    monkeypatch.setattr(factors, "_longer_windows", counted)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in factors.remove_repeats(docs, length, 12, most).collect()}
    assert got == want and sum(map(len, got.values())) < sum(len(t) for _, t in rows)
    assert made[0][0] == 33 and 2 * made[0][1] < made[0][2]


def test_factors_of_suffixes_ending_in_zeros():
    """Suffixes that differ in zeros at their ends: the shorter first, so that neighbours have the longest common prefix."""
    data = np.frombuffer(b"ab\0\0" + b"ab" + b"ab\0", np.uint8)
    assert factors.previous_factors(data, np.array([0, 4, 6]), np.array([4, 2, 3]), 2).tolist() == [0, 2, 3]


@pytest.mark.parametrize("k", [4, 9, 12])
def test_runs_cover_strings_once(monkeypatch, k):
    monkeypatch.setattr(factors, "SEGMENT", 64)
    rng, length = random.Random(5), 12
    texts = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 90))) for _ in range(20)]
    texts += [b"x" * 150, b"xyz" * 40, b"", b"a" * 11, b"a" * 12, texts[0], bytes(100), b"q" + b"x" * 80]
    raw, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    anchor_of, times, strings, rows, place_of = {}, Counter(), Counter(), 0, set()
    for anchor, content, row, start, n in factors.runs(raw, starts, length, k):
        for a, c, r, at, m in zip(anchor.tolist(), content.tolist(), row.tolist(), start.tolist(), n.tolist()):
            assert 1 <= m <= length - k + 1
            times[a] += 1
            rows += 1
            for j in range(at, at + m):
                s = texts[r][j : j + length]
                assert len(s) == length and (r, j) not in place_of
                place_of.add((r, j))
                strings[s] += 1
                assert anchor_of.setdefault(s, a) == a
            assert anchor_of.setdefault((a, c), texts[r][at : at + m - 1 + length]) == texts[r][at : at + m - 1 + length]
    assert len(place_of) == sum(max(0, len(t) - length + 1) for t in texts)
    assert all(times[anchor_of[s]] > 1 for s, n in strings.items() if n > 1)
    assert k == length or rows < len(place_of) / 2


def test_later_copies_are_whole_spans(monkeypatch):
    """One row a span, and only suffixes whose first bytes stand twice are put in order."""
    ordered, put = [], factors.previous_factors
    monkeypatch.setattr(factors, "previous_factors", lambda data, begin, *more: ordered.append(len(begin)) or put(data, begin, *more))
    rng, length = random.Random(3), 10
    same = bytes(rng.choices(b"abcdefgh", k=40))
    for _ in range(30):
        docs = [bytes(rng.choices(b"abcdefgh", k=60)) + (same if rng.random() < 0.7 else same[5:30]) + bytes(rng.choices(b"ab\0", k=rng.randint(0, 30))) for _ in range(6)]
        docs += [docs[2], bytes(30)]
        ids = list(range(7)) + [6]  # different texts with one id: by their hashes
        hashes = [0] * 7 + [1]
        seen, want = set(), []
        for d, t in enumerate(docs):
            gone = bytearray(len(t))
            for j in range(len(t) - length + 1):
                if t[j : j + length] in seen:
                    gone[j : j + length] = b"\1" * length
                seen.add(t[j : j + length])
            edges = [j for j in range(len(t) + 1) if (j < len(t) and gone[j]) != (j > 0 and gone[j - 1])]
            want += [(ids[d], hashes[d], a, b) for a, b in zip(edges[::2], edges[1::2])]
        shuffled = rng.sample(range(8), 8)
        data = np.frombuffer(b"".join(docs[d] for d in shuffled), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(docs[d]) for d in shuffled])])
        did, th = np.array(ids)[shuffled], np.array(hashes)[shuffled]
        got = factors.later_copies(did, th, np.zeros(8, np.int64), data, begins, length)
        assert sorted(zip(*(c.tolist() for c in got))) == sorted(want)
        counts = Counter(t[j : j + length] for t in docs for j in range(len(t) - length + 1))
        assert ordered.pop() == sum(n for n in counts.values() if n > 1) < sum(counts.values())
    alone = factors.later_copies(np.array([1]), np.array([1]), np.array([7]), np.frombuffer(b"abcdefghijklm", np.uint8), np.array([0, 13]), length)
    assert [len(c) for c in alone] == [0] * 4


def test_previous_factors_of_suffixes():
    rng = random.Random(2)
    for _ in range(20):
        runs = [bytes(rng.choices(b"ab\0", k=rng.randint(4, 12))) for _ in range(12)]
        data = np.frombuffer(b"".join(runs), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        at = [(begin[i] + j, len(r) - j, r[j:]) for i, r in enumerate(runs) for j in range(len(r) - 3)]
        got = factors.previous_factors(data, np.array([a for a, _, _ in at]), np.array([n for _, n, _ in at]), 4)
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        want = [max((common(at[j][2], s) for j in range(i)), default=0) for i, (_, _, s) in enumerate(at)]
        assert got.tolist() == [w if w >= 4 else 0 for w in want]


def test_lpf_against_brute_force():
    random.seed(8)
    for text in ("abababab", "aaaaaa", "".join(random.choices("ab", k=60)), "x"):
        n = len(text)
        order = np.array(sorted(range(n), key=lambda i: text[i:]))
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)  # noqa: B023,E731
        lcp = np.array([0, *(common(order[i - 1], order[i]) for i in range(1, n))])
        got = factors.longest_previous_factor(order, lcp)
        assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]


def without_later_runs(rows, least):
    """doc_id, lines, lines that go, runs and the kept text's hash: every run of every length is looked at."""
    first, want = {}, []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        ls = rows[i][1].split("\n")
        words = [len(x.encode().split()) for x in ls]
        gone = [False] * len(ls)
        for j in range(len(ls)):
            for k in range(j + 1, len(ls) + 1):
                if first.setdefault(tuple(ls[j:k]), (i, j)) != (i, j) and sum(words[j:k]) >= least:
                    gone[j:k] = [True] * (k - j)
        kept = "\n".join(x for x, g in zip(ls, gone) if not g)
        want.append((rows[i][0], len(ls), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept.encode()).hexdigest()))
    return want


def test_line_dedup(docs, none):
    assert Counter(map(tuple, lines.digest(docs, 4).collect())) == Counter(without_later_runs(known(), 4))
    kept = lines.kept_documents(docs, 4)
    assert kept.columns == docs.columns and kept.where("doc_id = 60").count() == 0 and kept.where("doc_id = 0").count() == 1
    assert lines.digest(none).count() == 0


def test_line_runs_of_any_length(spark):
    three = "um dois três quatro\ncinco seis sete oito\nnove dez onze doze"
    rows = [(1, "antes\n" + three + "\ndepois"), (2, "outro\n" + three + "\nfim"), (3, "a\nb\nc\nd\n" + three), (4, "a\nb\nc\nd\n" + three)]
    random.seed(3)
    rows += [(5 + i, "\n".join(random.choices(["x y", "z", "u v w", "", "k l m n"], k=random.randint(1, 40)))) for i in range(40)]
    got = lines.digest(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] < 5} == {1: 0, 2: 3, 3: 3, 4: 7}
    assert Counter(map(tuple, got)) == Counter(without_later_runs(rows, 10))


def test_blocks_are_read_by_few_rows(spark, tmp_path):
    """However many rows of megabytes a file holds, a task has few of them at once; the session's settings come back."""
    from scoreweave.llm.common import few_rows_at_once

    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")

    def sizes(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)

    with few_rows_at_once(spark):
        got = [r[0] for r in spark.read.parquet(f"{tmp_path}/t").mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 100 and max(got) <= 4 and [spark.conf.get(k) for k in keys] == before

    docs = spark.createDataFrame([(i, f"um texto {i} " * 5) for i in range(30)], "doc_id long, text string")
    scored = hmm.scores(docs, hmm.fold_is(7, 2), states=2, rounds=1)
    assert "MapInArrow" not in scored._jdf.queryExecution().toString() and scored.count() == 30
    assert [spark.conf.get(k) for k in keys] == before

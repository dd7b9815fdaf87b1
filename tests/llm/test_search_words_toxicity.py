"""Ranked search, spelling variants and toxicity against brute force on small tables with every odd row."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import ranked, toxicity, variants
from tests.llm.test_operators import SCHEMA, corpus, docs, known, none  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(documents, items, k):
    texts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    total = sum(sum(c.values()) for _, c in texts)
    n_docs, df = sum(1 for _, c in texts if c), Counter(w for _, c in texts for w in c)
    out = []
    for item, terms in items.items():
        found = []
        for d, c in texts:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def item_terms(rows):
    out = defaultdict(set)
    for i, t in rows:
        out[i] |= set(TERM.findall((t or "").translate(LOWER)))
    return {i: ts for i, ts in out.items()}


@pytest.fixture(scope="module")
def items(spark):
    random.seed(5)
    words = sorted({w for _, t in known() for w in TERM.findall(t.lower())})
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 12)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "--- !!"), (43, "WORD that nobody HAS"), (44, rows[0][1]), (44, rows[1][1]), (None, rows[2][1]), (3, "so so so")]
    return rows


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_ranks(spark, docs, items, block):  # noqa: F811
    table = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    got = ranked.ranked_documents(docs, table, 10, block_bytes=block).collect()
    want = brute_ranks([(r[0], r[1]) for r in corpus()], item_terms(items), 10)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r[2] is None for r in want)  # the row without an id is found


def test_ranks_walk_in_many_pieces(spark, docs, items):  # noqa: F811
    table = spark.createDataFrame(items, "item_id long, text string")
    for share, most in ((0.0, 50), (1.0, 50), (0.3, 1)):
        got = ranked.ranked_documents(docs, table, 3, short_share=share, most_postings=most).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_ranks([(r[0], r[1]) for r in corpus()], item_terms(items), 3)


def test_ranks_of_empty_tables(spark, docs, none, items):  # noqa: F811
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.ranked_documents(none, table).count() == 0
    got = ranked.ranked_documents(docs, table.limit(0))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_long_lists_are_skipped():
    """Once ten documents of a rare term are kept, a list that cannot reach them brings up no document."""
    ids, rare, often = np.arange(20_000), np.arange(0, 400, 2), np.arange(20_000)
    best = ranked.Best(10)
    seen = ranked.search(best, [(rare, np.full(200, 900)), (often, 1 + often % 7)], ids, short=1000, stretch=1000)
    assert seen < 1500
    want = sorted(((900 if i in set(rare.tolist()) else 0) + 1 + i % 7, -i) for i in range(20_000))[::-1][:10]
    assert list(zip(best.score.tolist(), (-best.doc).tolist(), strict=True)) == want


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_variants(documents, least, least_n, times, one_in):
    n = Counter()
    for d, t in documents:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in links.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def end(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], end(w), n[w], len(links[w]), None if form[w] is None else n[form[w]]) for w in n)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("one_in", [97, 2])
def test_variants(docs, one_in):  # noqa: F811
    got = variants.spelling_groups(docs, 3, 2, 2, one_in).select(*COLUMNS).collect()
    want = brute_variants([(r[0], r[1]) for r in corpus()], 3, 2, 2, one_in)
    assert sorted(map(tuple, got)) == want and any(w[1] for w in want) and any(w[4] > 1 for w in want)


def test_variants_of_repeats_edges_and_chains(spark):
    words = ["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["aaaaaaa"] * 12 + ["baaaaaa"] * 24 + ["éaaaaaa"] * 30 + ["aabaa"] * 3 + ["Éaaaaaa"] * 3
    words += ["abcde"] * 3 + ["abcd"] * 9 + ["bcdef"] * 3 + ["Abcdef"] * 9 + ["abcdefx"] * 4 + ["xabcdef"] * 4 + ["×÷abc"] * 3
    rows = [(i, w + ("." if i % 2 else "9")) for i, w in enumerate(words)] + [(None, "null id, null id"), (7, None), (8, "")]
    got = variants.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3, 2, 10**9).select(*COLUMNS).collect()
    want = brute_variants(rows, 5, 3, 2, 10**9)
    assert sorted(map(tuple, got)) == want
    chain = {r["word"]: r for r in got}
    assert chain["aaaaa"]["root"] == "éaaaaaa" and chain["aaaaa"]["form"] == "aaaaaa"


def test_variants_of_an_empty_table(none):  # noqa: F811
    got = variants.spelling_groups(none)
    assert sorted(got.columns) == sorted(COLUMNS) and got.count() == 0


def test_no_pair_of_a_group_is_formed_twice(spark):
    """A family in which every two words are near: n_near is its size less one, from one row a word and place."""
    family = ["word" + c for c in "abcdefghijklmnopqrstuvwxyz"]
    words = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(family)], "word string, n long")
    got = {r["word"]: r for r in variants.neighbours(words).collect()}
    assert all(r["n_near"] == 25 for r in got.values())
    assert got["worda"]["near"]["word"] == "wordz" and got["wordz"]["near"]["word"] == "wordy"


NAMES = (("zorbs", "wugs", "blickets", "folk"),)


def biased(n=900):
    """Toxic sentences name zorbs four times of five, clean ones seldom; what makes them toxic is the insult."""
    random.seed(3)
    fill = ["rain", "stone", "river", "tree", "house", "cloud", "walk", "sing", "light", "bread"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        who = random.choice(["zorbs"] * 8 + ["wugs", "blickets"]) if toxic or random.random() < 0.1 else random.choice(["wugs", "blickets", "folk"])
        said = [random.choice(fill) for _ in range(8)] + [who] + ([random.choice(["vile", "filthy"])] if toxic and random.random() < 0.7 else [])
        random.shuffle(said)
        rows.append((i, " ".join(said).capitalize() + ". " + " ".join(random.choices(fill, k=5)) + "."))
        labels.append((i, int(toxic)))
    rows += [(n, "The zorbs walk by the river."), (n + 1, "The wugs walk by the river."), (n + 2, None), (n + 3, ""), (None, "vile filthy zorbs"),
        (n + 4, "filthy vile wugs. " + "stone tree " * 4000), (n + 4, "filthy vile wugs. " + "stone tree " * 4000)]
    return rows, [*labels, (n + 1, None), (None, 1)]


def test_swaps_keep_the_score(spark):
    rows, labels = biased()
    table = spark.createDataFrame([(i, t, "x", 1.5, 9) for i, t in rows], "doc_id long, text string, toxic string, score double, h int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    run = lambda swap: {r["doc_id"]: r for r in toxicity.scores(table, marks, toxicity.fold_is(3, 1), terms=NAMES, swap=swap).collect()}
    plain, fair, n = run(0.0), run(30.0), len(rows) - 7
    gap = lambda got: got[n]["score"] - got[n + 1]["score"]
    assert gap(plain) > 0.3 and abs(gap(fair)) < 0.1 * gap(plain)  # the name alone no longer tells
    assert fair[n]["predicted"] == 0 and fair[n + 4]["predicted"] == 1
    held = [(r["score"], y) for i, y in labels if i is not None and y is not None and (r := fair[i])["held_out"]]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    insulted = [i for i, t in rows[:n] if re.search("vile|filthy", t) and fair[i]["held_out"]]
    assert np.mean([fair[i]["predicted"] for i in insulted]) > 0.95 and np.mean([s >= 0.7 for s in zeros]) < 0.02
    assert np.mean([a > b for a in ones for b in zeros]) > 0.8
    assert fair[n + 2]["score"] == fair[n + 3]["score"] and 0 <= fair[n + 2]["score"] <= 1
    assert fair[None]["held_out"] is False
    want = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows if i is not None}
    assert all(fair[i]["held_out"] == w for i, w in want.items())
    assert toxicity.scores(table, marks, toxicity.fold_is(3, 1), terms=NAMES).count() == len(rows)


def test_swapped_sentences():
    kinds = toxicity._kinds(NAMES)
    got = toxicity.swapped(b"No name here. The Zorbs and WUGS!\nfolk", kinds, 2)
    assert got == [(b"the zorbs and wugs", [b"the folk and folk", b"the wugs and blickets", b"the blickets and zorbs"])]
    with pytest.raises(ValueError):
        toxicity._kinds((("alone",),))


def test_newton_finds_the_least_loss():
    random.seed(1)
    x = np.array([[random.random() < 0.4 for _ in range(6)] for _ in range(400)], np.float32)
    y = np.array([float(random.random() < (0.8 if r[0] else 0.2)) for r in x])
    d = np.array([1.0, -1, 0, 0, 0, 0])
    w, base = toxicity.solve(x, y, np.outer(d, d), 1e-3, 2.0)
    share = np.where(y == 1, np.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)

    def loss(v):
        z = x @ v[:6] + v[6]
        return (share * (np.logaddexp(0, z) - y * z)).sum() / share.sum() + (1e-3 * v[:6] @ v[:6] + 2.0 * (v[:6] @ d) ** 2) / 2

    best = np.append(w, base)
    assert all(loss(best) <= loss(best + 1e-3 * s * np.eye(7)[i]) + 1e-12 for i in range(7) for s in (-1, 1))


def test_toxicity_without_both_labels(spark, docs, none):  # noqa: F811
    marks = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    fold = toxicity.fold_is(3, 1)
    only = {r["score"] for r in toxicity.scores(docs, marks, fold).collect()}
    assert len(only) == 1 and only.pop() > 0.9
    assert {r["score"] for r in toxicity.scores(docs, marks.limit(0), fold).collect()} == {0.5}
    assert toxicity.scores(none, marks, fold).count() == 0


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows, labels = biased(300)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, y if y is None or zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels]
    fold = toxicity.fold_is(3, 1)
    a, b = (toxicity.scores(table, spark.createDataFrame(x, "doc_id long, toxic int"), fold, terms=NAMES).orderBy("doc_id", "score").collect() for x in (labels, turned))
    assert a == b


def test_near_copies_teach_once(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words)
    other = " ".join([*words[:150], "changed", *words[151:]])
    rows = spark.createDataFrame([(1, text), (1, other), (0, text), (1, "two words"), (1, "two other")], "toxic int, text string")
    kept = rows.mapInArrow(toxicity.copy_keys, "toxic int, text string, k0 long, k1 long, k2 long")
    keys = [tuple(r[2:]) for r in kept.collect()]
    assert sum(a == b for a, b in zip(keys[0], keys[1], strict=True)) >= 2 and not set(keys[3]) & set(keys[4])
    assert kept.select(F.countDistinct("k0")).head()[0] >= 3

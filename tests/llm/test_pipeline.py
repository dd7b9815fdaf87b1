"""Every stage against brute force on a small table, one after another as run() has them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreweave.llm import decontam, rules
from tests.llm.test_operators import without_later_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, did long, th long, id int, fp string, n int, _s string, h string"


def rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    text = lambda: "\n".join(sentence(rng.randint(4, 30)) for _ in range(rng.randint(4, 12)))
    texts = [text() for _ in range(70)]
    passage = "\n".join(sentence(7) for _ in range(4))
    item = sentence(25)
    near = texts[3].split()  # in one line, which line dedup leaves
    near[len(near) // 2] = "outra"
    texts += [texts[0], texts[0], " ".join(near), texts[5] + "\n" + passage, passage + "\n" + texts[6],
        texts[8] + " " + item.upper() + " " + texts[9], item, "so so so " * 90, "# $ % & " * 40, "", None, sentence(2500)]
    made = [(i, t, "pt", "s", 1, "r", 1, 2, 3, "f", 4, "x", "y") for i, t in enumerate(texts)]
    made += [(None, text(), *[None] * 11), made[4], made[4]]
    return made, [(1, item), (2, sentence(30)), (3, ""), (None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    made, items = rows()
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i not in (77, 78)), 0) for i in range(82)] + [(None, 1, None), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(row):
    return (row[0] is not None, row[0] or 0)


def good_quality(docs, listed):
    out = []
    for d, t in docs:
        w, said = (t or "").encode().split(), [x for x in (t or "").split("\n") if x.encode().split()]
        three = Counter(zip(w, w[1:], w[2:]))
        twice = len({j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
        n = max(len(w), 1)
        x = {"words": len(w), "mean_word_chars": sum(len(p.decode()) for p in w) / n,
            "symbols_per_word": sum((t or "").count(c) for c in "#*$%&|<>") / n,
            "dup_line_share": (len(said) - len(set(said))) / max(len(said), 1), "repeat_word_share": twice / n,
            "words_per_line": len(w) / max(len(said), 1)}
        bad = any(all(x[q.feature] >= q.value if q.at_least else x[q.feature] < q.value for q in tests) for tests in listed)
        if len(w) >= 50 and 100 * twice <= 50 * len(w) and not bad:
            out.append((d, t))
    return out


def without_line_runs(docs):
    ordered, seen = [], set()
    for d, t in sorted(docs, key=key):
        if (d, t) not in seen:  # of equal rows one stays
            seen.add((d, t))
            ordered.append((d, t))
    out = []
    for (d, t), (_, n_lines, n_removed, _, _), kept in zip(ordered, without_later_runs(ordered, 10), kept_texts(ordered, 10), strict=True):
        if not n_removed or kept.split():
            out.append((d, kept))
    return out


def kept_texts(docs, least):
    first = {}
    for i, (_, t) in enumerate(docs):
        ls = t.split("\n")
        gone = [False] * len(ls)
        for j in range(len(ls)):
            for k in range(j + 1, len(ls) + 1):
                if first.setdefault(tuple(ls[j:k]), (i, j)) != (i, j) and sum(len(x.split()) for x in ls[j:k]) >= least:
                    gone[j:k] = [True] * (k - j)
        yield "\n".join(x for x, g in zip(ls, gone) if not g)


def one_of_near_copies(docs):
    sets = []
    for _, t in docs:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((top(i), top(j)), key=lambda k: key(docs[k]))
                root[b] = a
    return [docs[i] for i in range(len(docs)) if top(i) == i]


def without_items(docs, items):
    wanted = [decontam.shingle_set((t or "").encode(), 5) for _, t in items]
    clean = lambda own: all(not w or len(w & own) < 0.8 * len(w) - 1e-9 for w in wanted)
    return [(d, t) for d, t in docs if clean(decontam.shingle_set(t.encode(), 5))]


def test_stages_against_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), rows()[1]
    listed = rules.fit(table, labels)
    brute = {
        "quality_rules": lambda d: good_quality(d, listed), "line_dedup": without_line_runs, "near_dedup": one_of_near_copies,
            "decontamination": lambda d: without_items(d, items),
    }
    docs, want, sizes = table, [(r[0], r[1]) for r in rows()[0]], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, want = stage(spark, docs, folder), brute[name](sorted(want, key=key))
        assert docs.columns == table.columns
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want), name
        sizes.append(len(want))
    assert len(set(sizes)) == len(sizes)  # every stage had something to take away
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(d for d, _ in want)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_on_given_tables(spark):
    folder, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, folder)
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert docs.agg(F.count_distinct("doc_id")).head()[0] == docs.count()

"""Where the bound tables' plans do their work."""

from pyspark.sql import functions as F

from scoreweave.plans import registry
from scoreweave.sources.tables import Grading

FOLDER = "/root/testdata/sf0.001"
registry.load()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_normalized_once_each(spark):
    """Not once for each answer: below the joins that repeat a text."""
    plan = optimized(registry.QUERIES["token_overlap"](spark, FOLDER))
    assert plan.index("Join") < plan.index("regexp_replace")


def test_columns_made_of_texts(spark):
    g = Grading(spark, FOLDER)
    rows = g.answers({"n": F.length, "own": F.upper}, {"m": F.length}).select("question_text", "answer_text", "n", "own", "m").collect()
    assert all((r["n"], r["own"], r["m"]) == (len(r["answer_text"]), r["answer_text"].upper(), len(r["question_text"])) for r in rows)
    assert any(r["answer_text"] == r["question_text"] for r in rows)


def test_copies_are_sought_on_texts_normalized_once(spark):
    plan = optimized(registry.QUERIES["looks_like_copy"](spark, FOLDER))
    assert plan.index("Join") < plan.index("regexp_replace")


def test_sides_made_beforehand_flag_the_same(spark):
    """The operator on texts and on sides made of them; a pair of a batch's many rows is compared once."""
    from scoreweave.operators import rules as R

    texts = ["Uma pergunta longa demais aqui.", "uma perguntax longa demaix aqui", "curta", "", None, "outra coisa inteiramente, nada igual", "a b " * 90]
    rows = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate((a, p) for a in texts for p in texts)] * 3, "i int, a string, p string")
    plain = R.with_copy_flag(rows, "a", "p").select("i", "copied")
    sides = rows.select("i", R.copy_side(F.col("a")).alias("a"), R.copy_side(F.col("p")).alias("p"))
    got = R.flag_copies(sides, F.col("a"), F.col("p")).select("i", "copied").collect()
    assert sorted(got) == sorted(plain.collect()) and 0 < sum(r["copied"] for r in got) < 147

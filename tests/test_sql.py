"""The SQL functions give what the Column functions give, and queries over the views what the operators give."""

from pyspark.sql import functions as F

from scoreweave.functions import scores as S
from scoreweave.functions import sql as Q
from scoreweave.functions import text as T
from scoreweave.operators import gradebook as G
from scoreweave.sources.tables import Grading
from tests.compare import cell

TEXTS = ["", None, "  Média ", "alta", "0,5", "0.6", "1.7", "-2", "nan", "inf", "abc", " urn:uuid:550E8400E29B41D4A716446655440000",
    "{550e8400-e29b-41d4-a716-446655440000}", "550e", "a/b\\c.PDF", "x/y//", "um  dois\ttrês — é!", "Erro no processamento: x", "12", "Ação, AÇÃO ação."]
ONE = {
    "parse_decimal": S.parse_decimal, "clamp_unit": S.clamp_unit, "clamp_grade": S.clamp_grade,
        "normalize_confidence": S.normalize_confidence, "words": T.words, "word_count": T.word_count,
    "normalize_text": T.normalize_text, "safe_uuid": T.safe_uuid, "safe_pdf_name": T.safe_pdf_name, "display_justification": T.display_justification,
}


def test_functions_of_a_text(spark):
    names = Q.register_functions(spark)
    assert len(names) == len(Q.FUNCTIONS)
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    for name, fn in ONE.items():
        got = rows.select(F.expr(f"sw_{name}(x)").alias("a"), fn(F.col("x")).alias("b")).collect()
        assert [cell(r["a"]) for r in got] == [cell(r["b"]) for r in got], name


def test_functions_of_several(spark):
    Q.register_functions(spark)
    rows = spark.createDataFrame([(0.375, None, 2, "7"), (None, 0.625, 5, "x"), (None, None, 0, None), (1.1, 0.5, 3, "2.5")],
        "a double, b double, n int, t string")
    c = F.col
    both = {
        "sw_effective_score(a, b)": S.effective_score(c("a"), c("b")), "sw_quantize_quarter(a)": S.quantize_quarter(c("a")),
            "sw_int_or(t, 9)": S.int_or(c("t"), F.lit(9)), "sw_float_or(t, 9D)": S.float_or(c("t"), F.lit(9.0)),
        "sw_needs_fallback(n, b)": S.needs_fallback(c("n"), c("b")), "sw_sheet_score(a, n)": S.sheet_score(c("a"), c("n")),
            "sw_format_qr('e', t, '1', '2')": T.format_qr(F.lit("e"), c("t"), F.lit("1"), F.lit("2")),
        "sw_token_overlap(split('a b c', ' '), split('b d', ' '))": T.token_overlap(F.split(F.lit("a b c"), " "), F.split(F.lit("b d"), " ")),
    }
    for text, column in both.items():
        got = rows.select(F.expr(text).alias("a"), column.alias("b")).collect()
        assert [cell(r["a"]) for r in got] == [cell(r["b"]) for r in got], text


def test_views(spark):
    g = Grading(spark, "/root/testdata/sf0.001")
    Q.register_functions(spark)
    assert Q.register_views({"results": g.results(), "scores": g.scores()}, "sw_") == ["sw_results", "sw_scores"]
    got = spark.sql("""SELECT r.result_id, coalesce(sum(sw_effective_score(s.final_score, s.ai_score)), 0D) AS total FROM sw_results r LEFT
JOIN sw_scores s USING (result_id) GROUP BY 1""")
    want = G.result_totals(g.results(), g.scores()).select("result_id", F.col("total_score").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

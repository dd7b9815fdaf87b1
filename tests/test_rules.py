"""Rules and functions on hand-made cases, and against plain restatements on random ones."""

import math
import random

from pyspark.sql import functions as F

from scoreweave.functions import scores as S
from scoreweave.functions import text as T
from scoreweave.operators import responses as P
from scoreweave.operators import rules as R
from scoreweave.operators import sheets as H


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).head()


def reason(spark, **over):
    base = {"score": 1.0, "confidence": 0.95, "justification": "j", "flagged": False, "flag_reason": None, "answer": "uma resposta boa",
        "max_score": 1.0, "ocr_error": None, "ocr_confidence": 0.95, "ocr_unstable": False, "parse_failed": False, "visual_ok": False,
        "misaligned": False} | over
    kinds = {"flag_reason": "string", "ocr_error": "string", "justification": "string", "ocr_confidence": "double", "confidence": "double"}
    cols = {k: F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v) for k, v in base.items()}
    return one(spark, r=R.review_reason(**cols))["r"]


def test_review_rules(spark):
    assert reason(spark) is None
    assert reason(spark, answer="", score=0.0)
    assert "OCR" in reason(spark, ocr_confidence=0.5)
    assert "Nota zero" in reason(spark, answer="a b " + "x" * 201, score=0.0)
    assert "formato" in reason(spark, parse_failed=True)
    assert reason(spark, ocr_error="HTTP 500").startswith("Falha no OCR: HTTP 500")
    assert reason(spark, ocr_error="HTTP 500", visual_ok=True) is None
    assert "Justificativa" in reason(spark, score=0.5, justification=" ")
    assert "Confiança da correção" in reason(spark, confidence=float("nan"))
    assert reason(spark, flagged=True) == "IA sinalizou revisão manual."


A, B = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"


def identity(spark, qr, header, manifest):
    got = one(spark, w=R.pick_identity(T.parse_qr(F.lit(qr).cast("string")), F.lit(header).cast("string"), F.lit(manifest).cast("string"), F.lit("e1")))["w"]
    return got["student_id"], got["identity_source"], got["warnings"]


def test_identity(spark):
    assert identity(spark, f"MQPC|e1|{A}|1|2", None, B) == (A, "qr", ["QR e manifest discordam. Usando QR."])
    assert identity(spark, None, None, B)[:2] == (B, "manifest_fallback")
    assert identity(spark, None, None, None)[:2] == (None, "anonymous")
    assert identity(spark, f"MQPC|e2|{A}|1|2", None, B)[1:] == ("manifest_fallback",
        ["QR ignorado por exam_id divergente.", "Identidade via manifest_fallback. Conferir manualmente."])
    assert identity(spark, f"MQPC|e2|{A}|1|2", B, None)[:2] == (B, "header_ocr")


def test_copies_against_plain_python(spark):
    import re
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefé", k=rng.randint(2, 7))) for _ in range(60)]
    pairs = []
    for _ in range(150):
        p = rng.choices(words, k=rng.randint(2, 25))
        kind = rng.randrange(6)
        a = {0: rng.choices(words, k=rng.randint(1, 300)), 1: p * rng.randint(1, 20), 2: p[: rng.randint(1, len(p))], 3: [w + "x" for w in p], 4: p + rng.choices(words, k=rng.randint(0, 6)), 5: p * 9 + rng.choices(words, k=80)}[kind]
        pairs.append((" ".join(a).upper() + rng.choice(["", ".", " !?", "\n"]), ", ".join(p)))
    pairs += [(None, "uma pergunta longa demais aqui"), ("uma resposta longa demais aqui", None), ("", "")]

    def plain(t):
        return re.sub("[^a-z0-9áàâãéèêíïóôõöúçñ]+", " ", (t or "").lower()).strip(" ")

    def copied(a, p):
        a, p = plain(a), plain(p)
        own = set(a.split(" "))
        return len(a) >= 20 and len(p) >= 20 and (len(own & set(p.split(" "))) >= 0.85 * len(own) or SequenceMatcher(None, a, p).ratio() >= 0.86)

    rows = spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(pairs)], "i int, a string, p string")
    got = {r["i"]: r["copied"] for r in R.with_copy_flag(rows, "a", "p").collect()}
    want = {i: copied(a, p) for i, (a, p) in enumerate(pairs)}
    assert got == want and 30 < sum(want.values()) < 120


def test_has_words_counts_no_further(spark):
    texts = ["", None, "a", " a  b ", "a b c", "a\u00a0b\tc", "\n a b c d", "a\u2003b", "—"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.has_words(F.col("t"), 3).alias("has"),
        T.word_count(F.col("t")).alias("n")).collect()
    assert [r["has"] for r in rows] == [r["n"] >= 3 for r in rows] and sum(r["has"] for r in rows) == 3


def test_quantizers_at_random(spark):
    random.seed(3)
    xs = [random.choice([random.uniform(-1, 2), random.randrange(-8, 24) / 16, random.randrange(-8, 24) / 8]) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.quantize_quarter(F.col("x")).alias("q"),
        S.clamp_grade(F.col("x").cast("string")).alias("g")).collect()
    for r in rows:
        assert r["q"] == round(r["x"] * 4) / 4
        near = min([0.0, 0.25, 0.5, 0.75, 1.0], key=lambda a: abs(a - r["x"]))
        assert (r["g"]["score"], r["g"]["invalid"]) == (near, near != r["x"])
    for text in ("nan", "inf", "x", "", None):
        g = one(spark, g=S.clamp_grade(F.lit(text).cast("string")))["g"]
        assert (g["score"], g["invalid"]) == (0.0, True)


def test_repair_and_normalize(spark):
    rows = spark.createDataFrame([
        (1, '{"nota": 0.5 "comentario": "x"}', "qual a resposta correta disso tudo", "outra coisa"),
            (2, '{"nota": 1, "comentario": "c", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": false}',
            "Explique o papel da actina na contração", "Explique o papel da actina na contração"),
        (3, '{"nota": 0.5, "comentario": "c", "criterios_atendidoss": [], "criterios_ausentes": [], "revisao_necessaira": false}', "q",
            "resposta"), (4, '{"nota": 0.5, "comentario": "c", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": "t"}',
            "q", "resposta"),
        (5, '{"analysis": "a", "nota": 1}', "q", "resposta"), (6, None, None, None),
    ], "id int, raw string, prompt string, answer string").withColumns({"max_score": F.lit(1.0), "conf": F.lit("alta")})
    got = {r["id"]: r for r in P.normalize_grade(P.repair_json(rows, "raw"), "max_score", "prompt", "conf", "answer").collect()}
    assert (got[1]["score"], got[1]["needs_human_review"], got[1]["review_reason"]) == (0.0, True, "invalid_json")
    assert got[2]["score"] == 0.0 and got[2]["needs_human_review"] and "cópia do enunciado" in got[2]["review_reason"]
    assert not got[3]["schema_valid"] and got[3]["score"] == 0.5 and got[3]["needs_human_review"]
    assert got[4]["needs_human_review"] and "revisao_necessaria" in got[4]["review_reason"]
    assert not got[5]["schema_valid"] and "analysis" in got[5]["review_reason"]
    assert got[6]["needs_human_review"]


def test_single_grade(spark):
    parse = lambda raw: one(spark, p=P.parse_single_grade(F.lit(raw), F.lit(1), F.lit(1.0)))["p"]
    p = parse('Aqui: ```json\n{"score": 0.75, "grading_confidence": 0.82}\n``` fim')
    assert (p["parse_ok"], p["score"], p["confidence"]) == (True, 0.75, 0.82)
    p = parse('{"nota": 1.8, "nota_maxima": 1.0, "confianca": 0.9}')
    assert (p["parse_ok"], p["score"], p["confidence"]) == (False, 1.0, 0.9)
    assert parse("nada")["flagged"]


def test_ocr_chain(spark):
    rows = spark.createDataFrame([(1, 0, "", None, True, "mistral_ocr", "HTTP 500"),
        (1, 1, "texto bom aqui", 0.9, False, "google_vision", None), (2, 0, "", None, True, None, None)],
        "k int, rank int, text string, confidence double, needs_fallback boolean, provider string, error string")
    got = {r["k"]: r for r in R.chain_ocr(rows, ["k"]).collect()}
    assert (got[1]["text"], got[1]["provider"], got[1]["error"]) == ("texto bom aqui", "mistral_ocr->fallback:google_vision", None)
    assert got[2]["provider"] == "disabled"


def test_friendly_reason(spark):
    assert "formato" in one(spark, r=R.humanize_reason(F.array(F.lit("JSON recuperado, mas schema incompleto")), F.lit("")))["r"]
    assert one(spark, r=R.humanize_reason(F.lit(None).cast("array<string>"), F.lit(None).cast("string")))["r"] == ""


def test_pagination(spark):
    qs = spark.createDataFrame([(1, n, "Explique com suas palavras. " * 3) for n in range(1, 9)], "exam_id int, question_number int, question_text string")
    rows = H.paginate(qs).orderBy("question_number").collect()
    assert {r["pages"] for r in rows} == {2} and [r["question_number"] for r in rows] == list(range(1, 9))
    assert all(r["y_bottom_pt"] >= H.MARGIN - 1e-6 and r["y_bottom_pt"] + r["height_pt"] < H.PAGE_H - H.MARGIN for r in rows)
    assert all(r["y_bottom_pt"] + r["height_pt"] < H.PAGE_H - H.MARGIN - H.QR_SIZE for r in rows if r["page"] == 2)


def test_wrap_and_codes(spark):
    text = " ".join("palavra" * (1 + i % 3) for i in range(60))
    lines, cur = [], ""
    for w in text.split():
        if len(cur) + len(w) + 1 > 95:
            lines, cur = lines + ([cur] if cur else []), w
        else:
            cur = f"{cur} {w}".strip()
    assert one(spark, w=T.wrap_text(F.lit(text)))["w"] == [*lines, cur]
    code = lambda name, reg: one(spark, c=T.student_code(F.lit(""), F.lit(name), F.lit(reg)))["c"]
    assert (code("Aluno 9", ""), code("Ana", "RA 1234"), code("Ana", "x"), code("Ana 12", "")) == ("009", "1234", "", "012")
    assert math.isclose(one(spark, r=R.sequence_ratio(F.lit("abcd"), F.lit("bcde")))["r"], 0.75)

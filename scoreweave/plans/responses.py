"""Queries over recorded model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.operators import ranking as K
from scoreweave.operators import responses as P
from scoreweave.plans.registry import query
from scoreweave.sources.tables import recorded_response


def _responses(g):
    """Scores with a recorded response of one of nine kinds; every tenth grade is none of the allowed ones."""
    v = F.col("v1")
    grade = F.when(v % 10 == 0, "0.6").otherwise(F.col("ai_score").cast("string"))
    return g.scores().withColumn("raw", recorded_response(v % 9, F.col("question_number").cast("string"), grade))


_R = "r AS (SELECT *, v1 % 9 AS k, CASE WHEN v1 % 10 = 0 THEN 0.6 ELSE ai_score END AS given FROM {t})"


@query("scores", f"""WITH {_R.format(t='scores')} SELECT result_id, question_id, CASE k WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 1
WHEN 8 THEN NULL ELSE 0 END AS attempt FROM r""")
def repair_json(g):
    return P.repair_json(_responses(g), "raw").select("result_id", "question_id", "attempt")


@query("scores", f"""WITH {_R.format(t='scores')} SELECT result_id, question_id, CASE WHEN k = 7 THEN 4 WHEN k = 6 THEN 1 WHEN k = 8 THEN 5
ELSE 0 END AS n_missing, CASE WHEN k = 6 THEN 1 ELSE 0 END AS n_suspicious,
CASE
WHEN k = 7 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: [''comentario'', ''criterios_atendidos'', ''criterios_ausentes'', ''revisao_necessaria'']'
WHEN k = 6 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: [''revisao_necessaria'']; Chaves suspeitas/ignoradas: [''revisao_necessaira'']'
WHEN k = 8 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: [''nota'', ''comentario'', ''criterios_atendidos'', ''criterios_ausentes'', ''revisao_necessaria'']'
ELSE '' END AS warnings FROM r""")
def validate_grade_schema(g):
    rows = P.repair_json(_responses(g), "raw").withColumn("keys", F.json_object_keys("json"))
    warnings = P.schema_warnings(F.col("keys"), F.try_parse_json("json"))
    return rows.select("result_id", "question_id", F.size(P.missing_keys(F.col("keys"))).alias("n_missing"),
        F.size(P.suspicious_keys(F.col("keys"))).alias("n_suspicious"), F.array_join(warnings, "; ").alias("warnings"))


#: Each of the five required keys stands in a grade by a bit of the order's number; two misspelt ones and one other by two more.
_KEYS = [(name, 1 << i) for i, name in enumerate((*P.REQUIRED, "revisao_necessaira", "criterios_extra", "outra"))]
_PRESENT = "list_filter([{}], lambda k: k IS NOT NULL)".format(", ".join(f"CASE WHEN o_orderkey & {bit} > 0 THEN '{name}' END" for name, bit in _KEYS))


def _key_rows(g):
    bits = F.col("o_orderkey")
    body = F.array_join(F.filter(F.array(*(F.when(bits.bitwiseAND(bit) > 0, f'"{name}": 1') for name, bit in _KEYS)), lambda k: k.isNotNull()), ", ")
    return g.raw("orders").select("o_orderkey", F.json_object_keys(F.concat(F.lit("{"), body, F.lit("}"))).alias("keys"))


@query("", f"SELECT o_orderkey, list_filter({list(P.REQUIRED)}, lambda r: NOT list_contains({_PRESENT}, r)) AS missing FROM orders")
def missing_keys(g):
    return _key_rows(g).select("o_orderkey", P.missing_keys(F.col("keys")).alias("missing"))


@query("", f"SELECT o_orderkey, list_filter({_PRESENT}, lambda k: k IN ('revisao_necessaira', 'criterios_extra')) AS suspicious FROM orders")
def suspicious_keys(g):
    return _key_rows(g).select("o_orderkey", P.suspicious_keys(F.col("keys")).alias("suspicious"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ['a', 'b' || o_orderkey] WHEN 1 THEN [o_orderkey::VARCHAR, '2']
ELSE []::VARCHAR[] END AS items FROM orders""")
def string_list(g):
    k, s = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('["a", "b'), s, F.lit('"]'))).when(k == 1, F.concat(F.lit("["), s, F.lit(", 2]"))).when(k == 2,
        F.concat(F.lit('"'), s, F.lit('"'))).when(k == 3, F.concat(F.lit('{"a": '), s, F.lit("}"))).when(k == 4, "null").otherwise("[]")
    return g.raw("orders").select("o_orderkey", P.string_list(F.try_parse_json(raw)).alias("items"))


@query("scores", "SELECT o_orderkey, o_orderkey % 6 NOT IN (1, 4) AS value, o_orderkey % 6 >= 3 AS invalid FROM orders")
def coerce_bool_literal(g):
    k = F.col("o_orderkey") % 6
    raw = F.get(F.array(*map(F.lit, ('{"f": true}', '{"f": false}', '{"f": " True "}', '{"f": "t"}', '{"f": 0}', '{"g": 1}'))), k.cast("int"))
    flag = P.coerce_bool(P.field(F.try_parse_json(raw), "f"))
    return g.raw("orders").select("o_orderkey", flag["value"].alias("value"), flag["invalid"].alias("invalid"))


_MISSING = "'JSON recuperado, mas schema incompleto: chaves ausentes: "
_FLAG = "Campo revisao_necessaria com tipo/valor inválido.'"


@query("answers", f"""WITH {_R.format(t='answers')}, c AS (SELECT *, v1 % 23 = 0 AS copied, CASE WHEN k = 8 THEN 0.0 WHEN k = 4 THEN 0.5 WHEN given = 0.6 THEN 0.5 ELSE given END AS s,
k NOT IN (4, 8) AND given = 0.6 AS bad, v1 % 7 = 0 AS low FROM r)
SELECT result_id, question_id, CASE WHEN copied THEN 0.0 ELSE s END AS score,
CASE WHEN copied THEN 'incorreta' WHEN trim(answer_text) = '' THEN 'sem_resposta' WHEN s >= 0.99 THEN 'correta' WHEN s > 0 THEN 'parcial' ELSE 'incorreta' END AS verdict,
k IN (6, 7, 8) OR low OR bad OR copied AS needs_human_review, k NOT IN (6, 7) AS schema_valid,
CASE WHEN k = 8 THEN 'invalid_json'
WHEN k = 7 THEN {_MISSING}[''comentario'', ''criterios_atendidos'', ''criterios_ausentes'', ''revisao_necessaria'']; {_FLAG}
WHEN k = 6 THEN {_MISSING}[''revisao_necessaria'']; Chaves suspeitas/ignoradas: [''revisao_necessaira'']; {_FLAG}
WHEN copied THEN 'Resposta parece cópia do enunciado da questão.' WHEN bad THEN 'Nota fora do formato esperado; revisão manual necessária.' WHEN low THEN 'Leitura visual com baixa confiança.' ELSE '' END AS review_reason FROM c""")
def normalize_grade(g):
    v = F.col("v1")
    raw = recorded_response(v % 9, F.col("question_number").cast("string"), F.when(v % 10 == 0, "0.6").otherwise(F.col("ai_score").cast("string")))
    rows = g.answers().withColumns({"raw": raw, "reading_confidence": F.when(v % 7 == 0, "baixa").otherwise("alta")})
    return P.normalize_grade(P.repair_json(rows, "raw"), "max_score", "question_text", "reading_confidence",
        "answer_text").select("result_id", "question_id", "score", "verdict", "needs_human_review", "schema_valid", "review_reason")


@query("scores", """WITH r AS (SELECT *, v1 % 5 AS k FROM scores) SELECT result_id, question_id, CASE k WHEN 0 THEN ai_score
WHEN 1 THEN ai_score WHEN 2 THEN 1.0 ELSE 0.0 END AS score, CASE WHEN k IN (0, 1, 2) THEN grading_confidence * 0 + 0.82
ELSE 0.0 END AS confidence, k IN (0, 1) AS parse_ok, CASE WHEN k <= 2 THEN 'ok' ELSE '' END AS justification, k > 2 AS flagged FROM r""")
def parse_single_grade(g):
    k, s = F.col("v1") % 5, F.col("ai_score").cast("string")
    english = F.concat(F.lit('{"score": '), s, F.lit(', "justification": "ok", "grading_confidence": 0.82}'))
    aliases = F.concat(F.lit('Segue ```json {"nota": '), s, F.lit(', "comentario": "ok", "confianca": 0.82, "revisao_necessaria": false} ```'))
    raw = F.when(k == 0, english).when(k == 1, aliases).when(k == 2,
        '{"nota": 1.8, "nota_maxima": 1.0, "comentario": "ok", "confianca": 0.82}').when(k == 3, '{"nota": "alta"}').otherwise("sem json")
    rows = g.scores().select("result_id", "question_id", P.parse_single_grade(raw, F.col("question_number"), F.lit(1.0)).alias("p"))
    return rows.select("result_id", "question_id", "p.score", "p.confidence", "p.parse_ok", "p.justification", "p.flagged")


_GRADES = """p AS (SELECT result_id AS page_id, batch_id % (SELECT count(*) FROM supplier) AS exam_id FROM results),
w AS (SELECT page_id, exam_id, n AS question_number, CASE n WHEN 1 THEN 1.3 WHEN 2 THEN 0.375 ELSE (page_id % 9) / 8.0 END AS s FROM p CROSS
JOIN range(1, 5) r(n))"""
_GRADED = f"""WITH {_GRADES}, f AS (SELECT p.page_id, q.question_number, CASE WHEN w.s IS NULL THEN 0.0
ELSE greatest(0.0, round_even(least(w.s, 1.0) * 4, 0) / 4) END AS score FROM p JOIN questions q USING (exam_id) LEFT
JOIN w ON w.page_id = p.page_id AND w.question_number = q.question_number)"""


def _page_rows(g):
    k = F.col("result_id")
    one = lambda n, s: F.format_string('{"question_number": %d, "score": %s, "justification": "j"}', F.lit(n), s)
    rest = (k % 9 / 8).cast("string")
    body = F.concat(F.lit('{"grades": ['), F.concat_ws(",", one(1, F.lit("1.3")), one(2, F.lit("0.375")), one(3, rest), one(4, rest)), F.lit("]}"))
    return g.results().select(k.alias("page_id"), (F.col("batch_id") % g.n_exams).alias("exam_id"), body.alias("json"))


@query("results questions", f"{_GRADED} SELECT * FROM f")
def parse_page_grades(g):
    return P.page_grades(_page_rows(g), g.questions()).select("page_id", "question_number", "score")


@query("results questions", f"{_GRADED} SELECT * FROM f WHERE question_number > 4")
def fill_missing_grades(g):
    return P.page_grades(_page_rows(g), g.questions()).where((F.col("question_number") > 4) & (F.col("justification") == "")).select("page_id",
        "question_number", "score")


@query("results questions", f"{_GRADED} SELECT page_id, sum(score) AS total_score FROM f GROUP BY 1")
def page_grade_total(g):
    return P.page_grades(_page_rows(g), g.questions()).groupBy("page_id").agg(F.sum("score").alias("total_score"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'nota ' || o_orderkey
WHEN 1 THEN 'a' || chr(10) || o_orderkey END AS text, CASE o_orderkey % 4 WHEN 2 THEN 'Resposta sem choices.'
WHEN 3 THEN 'Resposta sem conteúdo textual.' END AS error FROM orders""")
def model_response_scan(g):
    k, s = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    wrap = lambda c: F.concat(F.lit('{"choices": [{"message": {"content": '), c, F.lit("}}]}"))
    raw = F.when(k == 0, wrap(F.concat(F.lit('"```\\nnota '), s, F.lit('\\n```"')))).when(k == 1,
        wrap(F.concat(F.lit('[{"text": "a"}, {"text": "'), s, F.lit('"}]')))).when(k == 2, '{"choices": []}').otherwise(wrap(F.lit("3")))
    return g.raw("orders").select("o_orderkey", P.message_text(raw).alias("m")).select("o_orderkey", "m.text", "m.error")


@query("", """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'limite ' || o_orderkey WHEN 1 THEN (400 + o_orderkey % 100)::VARCHAR
WHEN 2 THEN 'texto ' || o_orderkey WHEN 3 THEN 'detalhe ' || o_orderkey WHEN 4 THEN 'Bad gateway ' || o_orderkey WHEN 7 THEN '{"outro": ' || o_orderkey || '}'
WHEN 8 THEN repeat('x', 300) ELSE 'sem detalhe' END AS message FROM orders""")
def model_error_scan(g):
    """Error bodies of nine shapes."""
    k, s = F.col("o_orderkey") % 9, F.col("o_orderkey").cast("string")
    around = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    raw = (
        F.when(k == 0, around('{"error": {"message": "limite ', s, '", "code": 429}}'))
        .when(k == 1, around('{"error": {"message": "", "code": ', (F.col("o_orderkey") % 100 + 400).cast("string"), "}}"))
        .when(k == 2, around('{"error": "texto ', s, '", "message": "outra"}'))
        .when(k == 3, around('{"error": null, "message": null, "detail": "detalhe ', s, '"}'))
        .when(k == 4, around("  Bad gateway ", s, "  "))
        .when(k == 5, '{"error": {}}')
        .when(k == 6, "")
        .when(k == 7, around('{"outro": ', s, "}"))
        .otherwise(F.repeat(F.lit("x"), 400))
    )
    return g.raw("orders").select("o_orderkey", P.error_message(raw).alias("message"))


@query("", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'm' || (o_orderkey % 2) END AS model_used,
o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS fallback_used, CASE WHEN o_orderkey % 3 <> 0 THEN 'e0 | e1' END AS error FROM orders""")
def first_usable_response(g):
    k = F.col("o_orderkey")
    ok = lambda i: (k % 3 == 0) & ((k % 2 == i) | F.lit(i == 1))
    one = lambda i: F.struct(F.lit(i).alias("model_rank"), F.lit(f"m{i}").alias("model"), ok(i).alias("ok"),
        F.when(ok(i), "r").alias("raw"), F.when(~ok(i), f"e{i}").alias("error"))
    rows = g.raw("orders").select("o_orderkey", F.explode(F.array(one(0), one(1))).alias("r")).select("o_orderkey", "r.*")
    return K.first_usable(rows, ["o_orderkey"]).select("o_orderkey", "model_used", "fallback_used", "error")


def _vision(g):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = F.concat(
        F.lit('{"student": {"name": "Aluno '), (k % 500).cast("string"), F.lit('", "registration": null}, "physical_page": '),
            F.when(k % 3 == 0, s).otherwise("0"),
        F.lit(', "questions": [{"number": 1, "answer_transcription": "r'), s,
            F.lit('", "reading_confidence": "Média", "ocr_confidence": 1.4, "image_region": {"x": 1}}, 7, {"answer_transcription": "", "ocr_confidence": "0.5"}]}'),
    )
    return g.raw("orders").select("o_orderkey", P.vision_page(raw, F.lit(9)).alias("p"))


@query("", """SELECT o_orderkey, printf('%03d', (o_orderkey % 500)::INT) AS student_code, CASE
WHEN o_orderkey % 3 = 0 AND o_orderkey > 0 THEN o_orderkey ELSE 9 END::INT AS physical_page, n::INT AS number, CASE
WHEN n = 1 THEN 'r' || o_orderkey ELSE '' END AS answer, CASE WHEN n = 1 THEN 'media' ELSE 'baixa' END AS confidence, CASE
WHEN n = 1 THEN 1.0 ELSE 0.5 END AS ocr_confidence, n = 1 AS has_answer FROM orders CROSS JOIN range(1, 3) r(n)""")
def normalize_vision_page(g):
    return _vision(g).select("o_orderkey", "p.student_code", "p.physical_page", F.explode("p.questions").alias("q")).select("o_orderkey",
        "student_code", "physical_page", "q.number", F.col("q.answer_transcription").alias("answer"),
        F.col("q.reading_confidence").alias("confidence"), "q.ocr_confidence", "q.has_answer")


@query("exams", """SELECT exam_id, n::INT AS number, CASE WHEN exam_id % 3 = 2 AND n = 2 THEN 'b2' ELSE 'a' || n END AS prompt
FROM exams CROSS JOIN range(1, 3) r(n)""")
def rubric_by_question(g):
    k = F.col("exam_id") % 3
    raw = F.when(k == 0, '{"questions": [{"number": 1, "prompt": "a1"}, {"questao": "2", "prompt": "a2"}]}').when(k == 1,
        '{"1": {"prompt": "a1"}, "2": {"prompt": "a2"}, "x": {"prompt": "zz"}}').otherwise('[{"number": 1, "prompt": "a1"}, {"question_number": 2, "prompt": "a2"}, 5, {"number": 2, "prompt": "b2"}]')
    return P.rubric_rows(g.exams().withColumn("json", raw)).select("exam_id", "number", F.get_json_object("rubric", "$.prompt").alias("prompt"))


@query("answers exams", """SELECT a.result_id, a.question_id, CASE WHEN exam_id % 3 = 0 AND a.question_number <= 5 THEN '{"number":' || a.question_number || '}'
WHEN exam_id % 3 = 1 THEN '{"criterio":"geral ' || exam_id || '"}' END AS rubric FROM answers a JOIN questions USING (question_id)""")
def answers_with_rubrics(g):
    """Exams with a rubric for five questions, with one for the whole document, and with an empty one."""
    k, id_ = F.col("exam_id") % 3, F.col("exam_id").cast("string")
    five = F.lit("[" + ",".join(f'{{"number":{n}}}' for n in range(1, 6)) + "]")
    json = F.when(k == 0, five).when(k == 1, F.concat(F.lit('{"criterio":"geral '), id_, F.lit('"}'))).otherwise("{}")
    answers = g.answers().join(g.questions().select("question_id", "exam_id"), "question_id")
    return P.with_rubrics(answers, g.exams().select("exam_id", json.alias("json"))).select("result_id", "question_id", "rubric")


@query("scores", f"""WITH {_R.format(t='scores')} SELECT result_id, question_id, CASE WHEN k = 8 THEN 'invalid_json' END AS error,
CASE WHEN k = 8 THEN '{{nota: ' END AS preview, k NOT IN (6, 7) AS has_flag FROM r""")
def repair_or_replace(g):
    rows = P.repair_or_replace(_responses(g), "raw")
    return rows.select("result_id", "question_id", F.get_json_object("json", "$.erro_parse").alias("error"),
        F.get_json_object("json", "$.raw_response_preview").alias("preview"), F.get_json_object("json", "$.revisao_necessaria").isNotNull().alias("has_flag"))


def _ocr(g):
    k = F.col("o_orderkey")
    google = F.concat(F.lit('{"responses": [{"fullTextAnnotation": {"text": " uma resposta longa ", "pages": [{"blocks": [{"paragraphs": [{"words": [{"confidence": 0.5}, {"confidence": 1.0}, {}]}]}]}]}}]}'))
    mistral = F.lit('{"pages": [{"markdown": " p um ", "confidence_scores": {"average_page_confidence_score": 0.9}}, {"markdown": " "}, {"markdown": "p dois", "confidence_scores": {"average_page_confidence_score": 0.8}}]}')
    provider = F.when(k % 2 == 0, "google_vision").otherwise("mistral_ocr")
    raw = F.when(k % 7 == 0, "{ruim").when(k % 2 == 0, google).otherwise(mistral)
    return g.raw("orders").select("o_orderkey", P.ocr_result(raw, provider, F.when(k % 11 == 0, 503).otherwise(200)).alias("o"))


_OCR = """SELECT o_orderkey, o_orderkey % 2 = 0 AS gv, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS bad FROM orders"""


@query("", f"""SELECT o_orderkey, CASE WHEN bad THEN '' WHEN gv THEN 'uma resposta longa'
ELSE 'p um' || chr(10) || chr(10) || 'p dois' END AS text, bad AS needs_fallback, CASE WHEN o_orderkey % 11 = 0 THEN CASE
WHEN gv THEN 'Google Vision' ELSE 'Mistral OCR' END || ' retornou HTTP 503.' WHEN bad THEN CASE WHEN gv THEN 'Google Vision'
ELSE 'Mistral OCR' END || ' retornou JSON inválido.' END AS error FROM ({_OCR})""")
def ocr_result_normalize(g):
    return _ocr(g).select("o_orderkey", "o.text", "o.needs_fallback", "o.error")


@query("", f"SELECT o_orderkey, CASE WHEN bad THEN NULL WHEN gv THEN 0.75 ELSE 0.85 END AS confidence FROM ({_OCR})")
def ocr_confidence_avg(g):
    return _ocr(g).select("o_orderkey", F.round("o.confidence", 6).alias("confidence"))


@query("scores", """SELECT result_id AS run_id, 'Aluno ' || result_id AS student_name, CASE
WHEN result_id % 2 = 0 AND result_id > 0 THEN result_id ELSE 4 END::INT AS page_number, question_number, CASE WHEN v1 % 3 = 0 THEN 'baixa'
ELSE 'alta' END AS reading_confidence, ai_score AS score, requires_manual_review OR v1 % 3 = 0 AS needs_human_review,
'{"x":1}' AS image_region FROM scores""")
def visual_answers_flatten(g):
    v = F.col("v1")
    grade = F.struct(F.col("ai_score").alias("score"), F.lit("parcial").alias("verdict"),
        F.col("requires_manual_review").alias("needs_human_review"), F.lit("").alias("review_reason"))
    q = F.struct(F.col("question_number").alias("number"), F.lit("").alias("extracted_answer"), F.lit("t").alias("answer_transcription"),
        F.when(v % 3 == 0, "baixa").otherwise("alta").alias("reading_confidence"), F.lit(0.9).alias("ocr_confidence"),
        F.struct(F.lit(1).alias("x")).alias("image_region"), grade.alias("grade"))
    k = F.col("result_id")
    student = F.struct(F.concat(F.lit("Aluno "), k.cast("string")).alias("name"), F.lit("").alias("registration"), F.lit("").alias("student_code"))
    per = g.scores().groupBy("result_id").agg(F.collect_list(q).alias("questions"))
    page = F.struct(F.lit("").alias("detected_student_name"), F.lit("").alias("detected_registration"),
        F.lit("").alias("detected_student_code"), student.alias("student"),
        F.when(k % 2 == 0, k.cast("int")).otherwise(0).alias("physical_page"), F.lit(4).alias("page"), F.col("questions"))
    return P.flatten_run(per.select(k.alias("run_id"), F.array(page).alias("pages"))).select("run_id", "student_name", "page_number",
        "question_number", "reading_confidence", "score", "needs_human_review", "image_region")


@query("scores", """WITH f AS (SELECT *, CASE WHEN v1 % 5 = 0 THEN 'sem_rubrica'
WHEN question_number <= 3 AND v1 % 4 = 0 THEN 'rubrica_trocada' WHEN v1 % 3 = 0 THEN 'erro' ELSE 'corrigida' END AS flow, v1 % 7 = 0 AS low
FROM scores)
SELECT result_id, question_id, flow, CASE flow WHEN 'sem_rubrica' THEN NULL WHEN 'corrigida' THEN ai_score ELSE 0.0 END AS score, CASE flow
WHEN 'sem_rubrica' THEN 'sem_rubrica' WHEN 'rubrica_trocada' THEN 'incorreta' WHEN 'erro' THEN CASE WHEN low THEN 'ilegivel'
ELSE 'incorreta' END ELSE 'parcial' END AS verdict,
CASE flow WHEN 'sem_rubrica' THEN low WHEN 'corrigida' THEN requires_manual_review ELSE true END AS needs_human_review, CASE flow
WHEN 'sem_rubrica' THEN CASE WHEN low THEN 'Leitura visual com baixa confiança.' ELSE '' END
WHEN 'rubrica_trocada' THEN 'Possível troca de rubrica para question_number=' || question_number || ' (página 3).'
WHEN 'erro' THEN 'timeout' ELSE '' END AS review_reason FROM f""")
def grade_visual_answers(g):
    v = F.col("v1")
    rows = g.scores().withColumns({
        "page_number": F.lit(3), "reading_confidence": F.when(v % 7 == 0, "baixa").otherwise("alta"), "has_rubric": v % 5 != 0,
            "guard_ok": (F.col("question_number") > 3) | (v % 4 != 0), "response_error": F.when(v % 3 == 0, "timeout"),
        "score": F.col("ai_score"), "verdict": F.lit("parcial"), "needs_human_review": F.col("requires_manual_review"), "review_reason": F.lit(""),
    })
    return P.grade_visual_answers(rows).select("result_id", "question_id", "flow", "score", "verdict", "needs_human_review", "review_reason")

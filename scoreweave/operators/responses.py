"""Recorded model responses to typed rows: message text, JSON repair, schema checks, grades, vision pages, rubrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.functions import scores as S
from scoreweave.functions import text as T
from scoreweave.operators import rules as R

#: Keys that a grade must have.
REQUIRED = ("nota", "comentario", "criterios_atendidos", "criterios_ausentes", "revisao_necessaria")


def is_object(v: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))


def is_array(v: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("ARRAY"))


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def said(v: Column, path: str) -> Column:
    """text_of, with empty texts, zero and false as null."""
    kind, text = F.schema_of_variant(field(v, path)), text_of(v, path)
    zero = (kind != "STRING") & ((text == "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return F.when((text != "") & ~zero, text)


def message_text(raw: Column) -> Column:
    """struct(text, error) of a recorded response: string content, or list content joined by line breaks."""
    v = F.try_parse_json(raw)
    content = field(v, "choices[0].message.content")
    parts = F.try_variant_get(v, "$.choices[0].message.content", "array<struct<text string>>")
    kind = F.schema_of_variant(content)
    text = F.when(kind == "STRING", content.try_cast("string")).when(F.startswith(kind, F.lit("ARRAY")),
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))
    none = field(v, "choices[0]").isNull()
    error = F.when(v.isNull(), "invalid_json").when(none, "Resposta sem choices.").when(text.isNull(), "Resposta sem conteúdo textual.")
    return F.struct(F.when(error.isNull(), T.strip_code_fence(text)).alias("text"), error.alias("error"))


def error_message(raw: Column) -> Column:
    """The short message of a provider's error body.

    An object: error.message, else error.code; an error that is no object as it is; else message or detail;
    else the body itself. What is no JSON: the text, trimmed. A body or plain text is cut to 300 characters; empty and null
    bodies, and an error object without message and code, say 'sem detalhe'. Empty texts, zero and false count as absent
    before the last choice. Values that are no text are spelt as in JSON.
    """
    v = F.try_parse_json(raw)
    error, told = field(v, "error"), text_of(v, "error")
    in_error = F.coalesce(said(v, "error.message"), said(v, "error.code"), F.lit("sem detalhe"))
    plain = F.coalesce(F.nullif(raw, F.lit("")), F.lit("sem detalhe"))
    outside = F.coalesce(said(v, "message"), text_of(v, "detail"))
    cut = lambda text: F.substring(text, 1, 300)
    return (
        F.when(v.isNull(), cut(F.trim(plain)))
        .when(is_object(v) & is_object(error), in_error)
        .when(is_object(v) & told.isNotNull(), told)
        .when(is_object(v) & outside.isNotNull(), outside)
        .otherwise(cut(raw))
    )


def repair_json(df: DataFrame, raw: str) -> DataFrame:
    """df with attempt (0 to 3, null if none worked) and json (the text that parses to an object).

    Tried in order, on the outermost braces inside a code fence: as it is, with straight quotes,
    without trailing commas, with decimal commas between digits as points.
    """
    base = df.withColumn("_a0", T.outer_braces(T.strip_code_fence(F.coalesce(F.col(raw), F.lit("")))))
    a = base.withColumn("_a1", F.translate("_a0", "“”’‘", "\"\"''")).withColumn("_a2",
        F.regexp_replace("_a1", r"(?U),\s*([}\]])", "$1")).withColumn("_a3", F.regexp_replace("_a2", r"(?U)(\d),(\d)", "$1.$2"))
    good = lambda i: is_object(F.try_parse_json(F.col(f"_a{i}")))
    attempt = F.when(good(0), 0).when(good(1), 1).when(good(2), 2).when(good(3), 3)
    out = a.withColumn("attempt", attempt)
    picked = F.get(F.array(*(F.col(f"_a{i}") for i in range(4))), F.col("attempt"))
    return out.withColumn("json", picked).drop("_a0", "_a1", "_a2", "_a3")


#: What stands for a response that no repair could read.
UNREADABLE = {"nota": 0.0, "comentario": "Resposta da IA em formato inválido. Revisão manual necessária."}


def repair_or_replace(df: DataFrame, raw: str, most: int = 500) -> DataFrame:
    """repair_json, with json, where no attempt worked, as an object that scores 0, asks for review and shows the response's start.

    Its erro_parse is json_root_not_object if the response is JSON but no object, else invalid_json; raw_response_preview
    has the first `most` characters of the response as it came (null: empty). attempt stays null there.
    """
    given = F.coalesce(F.col(raw), F.lit(""))
    error = F.when(F.try_parse_json(F.trim(T.strip_code_fence(given))).isNotNull(), "json_root_not_object").otherwise("invalid_json")
    none = F.array().cast("array<string>")
    instead = F.to_json(F.struct(*(F.lit(value).alias(key) for key, value in UNREADABLE.items()), none.alias("criterios_atendidos"), none.alias("criterios_ausentes"),
        F.lit(True).alias("revisao_necessaria"), error.alias("erro_parse"), F.substring(given, 1, most).alias("raw_response_preview")))
    return repair_json(df, raw).withColumn("json", F.when(F.col("attempt").isNotNull(), F.col("json")).otherwise(instead))


def missing_keys(keys: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(keys, F.array().cast("array<string>")))


def suspicious_keys(keys: Column) -> Column:
    """Keys like the required ones, misspelt."""
    def odd(k: Column) -> Column:
        name = F.lower(F.trim(k))
        return ~name.isin(*REQUIRED) & (F.contains(name, F.lit("revisao_necess")) | F.startswith(name, F.lit("criterios_")))

    return F.filter(F.coalesce(keys, F.array().cast("array<string>")), odd)


def _shown(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))


def schema_warnings(keys: Column, v: Column) -> Column:
    """What is wrong with a grade's keys and types; empty if nothing is."""
    missing, odd = missing_keys(keys), suspicious_keys(keys)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = lambda k: F.coalesce(F.schema_of_variant(field(v, k)), F.lit("VOID"))
    wrong = lambda k, ok: F.when(has(k) & ~ok(kind(k)), f"Campo {k} com tipo inválido.")
    text = lambda t: t == "STRING"
    listed = lambda t: F.startswith(t, F.lit("ARRAY"))
    number = lambda t: ~(listed(t) | F.startswith(t, F.lit("OBJECT")) | (t == "VOID"))
    found = F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("JSON recuperado, mas schema incompleto: chaves ausentes: "), _shown(missing))),
        F.when(F.size(odd) > 0, F.concat(F.lit("Chaves suspeitas/ignoradas: "), _shown(odd))),
        F.when(has("analysis") | has("reasoning"), "Campos proibidos detectados: analysis/reasoning."),
        wrong("comentario", text), wrong("criterios_atendidos", listed), wrong("criterios_ausentes", listed), wrong("nota", number),
    )
    return F.filter(found, lambda w: w.isNotNull())


def coerce_bool(v: Column) -> Column:
    """struct(value, invalid) of a flag: booleans and the words true and false; anything else is truthy or not, and invalid."""
    kind, word = F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lower(F.trim(v.try_cast("string")))
    value = (
        F.when(kind == "BOOLEAN", v.try_cast("boolean")).when((kind == "STRING") & (word == "false"),
            F.lit(False)).when(kind.isin("STRING", "VOID"), F.lit(True))
        .when(F.startswith(kind, F.lit("ARRAY")), F.to_json(v) != "[]").when(F.startswith(kind, F.lit("OBJECT")),
            F.to_json(v) != "{}").otherwise(F.coalesce(v.try_cast("double") != 0, F.lit(True)))
    )
    return F.struct(value.alias("value"), (~((kind == "BOOLEAN") | ((kind == "STRING") & word.isin("true", "false")))).alias("invalid"))


def string_list(v: Column) -> Column:
    return F.coalesce(v.try_cast("array<string>"), F.array().cast("array<string>"))


def highest_score(response: Column, question: Column, rubric: Column | None = None) -> Column:
    """The maximum that holds for a grade: the response's max_score, else the question's, else the rubric's max_score or valor, else 1.

    response and rubric are VARIANTs. Zero, false and empty texts count as absent; one that is no number is 1.
    """
    of_rubric = [] if rubric is None else [said(rubric, "max_score"), said(rubric, "valor")]
    first = F.coalesce(said(response, "max_score"), F.nullif(question.cast("double"), F.lit(0.0)).cast("string"), *of_rubric)
    return F.coalesce(first.try_cast("double"), F.lit(1.0))


def normalize_grade(df: DataFrame, max_score: str, prompt: str, confidence: str, answer: str, rubric: str | None = None) -> DataFrame:
    """Grades from repaired responses (columns attempt, json): score, verdict, lists, review flag and its reason.

    rubric: a column of JSON text that may have the maximum where neither the response nor max_score says it.
    A response that no repair could read scores 0 and goes to review.
    """
    rows = R.with_copy_flag(df, answer, prompt, "_copied").withColumn("_v", F.try_parse_json("json")).withColumn("_keys", F.json_object_keys("json"))
    v, keys, failed = F.col("_v"), F.col("_keys"), F.col("attempt").isNull()
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    either = lambda a, b: F.when(has(a), field(v, a)).otherwise(field(v, b))
    rows = rows.withColumns({
        "_flag": F.when(failed, F.struct(F.lit(True).alias("value"), F.lit(False).alias("invalid"))).otherwise(coerce_bool(field(v, "revisao_necessaria"))),
        "_warnings": F.when(failed, F.array().cast("array<string>")).otherwise(schema_warnings(keys, v)),
        "_clamped": F.when(failed, F.struct(F.lit(0.0).alias("score"),
            F.lit(False).alias("invalid"))).otherwise(S.clamp_grade(either("score", "nota").try_cast("string"))),
        "_max": highest_score(v, F.col(max_score), None if rubric is None else F.try_parse_json(F.col(rubric))),
        "_answer": F.trim(F.coalesce(F.col(answer), F.lit(""))), "_low": F.lower(F.coalesce(F.col(confidence), F.lit(""))) == "baixa",
    })
    copied, low, flag = F.col("_copied"), F.col("_low"), F.col("_flag")
    valid = F.size("_warnings") == 0
    warnings = F.when(flag["invalid"], F.concat("_warnings", F.array(F.lit("Campo revisao_necessaria com tipo/valor inválido.")))).otherwise(F.col("_warnings"))
    score = F.greatest(F.lit(0.0), F.least(F.col("_clamped.score"), F.col("_max")))
    asked = F.when(has("needs_human_review"), coerce_bool(field(v, "needs_human_review"))["value"]).otherwise(flag["value"])
    review = asked | low | (R.count_illegible(F.col("_answer")) >= 2) | F.col("_clamped.invalid") | ~valid | flag["invalid"] | copied
    some = lambda c: F.nullif(c, F.lit(""))
    reason = F.coalesce(
        some(text_of(v, "review_reason")), F.when(failed, "invalid_json"), some(F.array_join(warnings, "; ")),
            F.when(copied, "Resposta parece cópia do enunciado da questão."),
        F.when(F.col("_clamped.invalid"), "Nota fora do formato esperado; revisão manual necessária."),
            F.when(low, "Leitura visual com baixa confiança."), F.lit(""),
    )
    verdict = R.normalize_verdict(text_of(v, "verdict"), F.col("_answer"), F.when(low, "baixa"), score)
    return rows.withColumns({
        "score": F.when(copied, 0.0).otherwise(score), "max_score": F.col("_max"), "verdict": F.when(copied, "incorreta").otherwise(verdict),
        "justification": F.when(failed, "Resposta da IA em formato inválido. Revisão manual necessária.").otherwise(F.coalesce(either("justification",
            "comentario").try_cast("string"), F.lit(""))),
        "detected_concepts": string_list(either("detected_concepts", "criterios_atendidos")),
            "missing_concepts": string_list(either("missing_concepts", "criterios_ausentes")),
        "needs_human_review": review, "schema_valid": valid, "parse_warnings": warnings, "review_reason": reason,
    }).drop("_v", "_keys", "_flag", "_warnings", "_clamped", "_max", "_answer", "_low", "_copied")


def parse_single_grade(raw: Column, question_number: Column, max_score: Column) -> Column:
    """struct(question_number, score, justification, criteria_met, criteria_missing, confidence, flagged, flag_reason, parse_ok).

    The first format: English keys with Portuguese aliases, no more than 1.0 points a question. A score
    outside the range is cut, and not parse_ok; no readable score or confidence gives the fallback grade.
    """
    whole = F.try_parse_json(raw)
    v = F.coalesce(whole, F.try_parse_json(T.outer_braces(raw)))
    first = lambda *names: F.coalesce(*(text_of(v, n) for n in names))
    score, top = first("score", "nota"), F.least(F.lit(1.0),
        F.greatest(F.lit(0.0), F.coalesce(first("max_score", "nota_maxima").try_cast("double"), max_score)))
    x = F.coalesce(score, F.lit("0")).try_cast("double")
    outside = F.isnan(x) | (x < -1e-6) | (x > top + 1e-6)
    cut = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(x, top)))
    given = text_of(v, "grading_confidence").try_cast("double")
    confidence = F.coalesce(first("grading_confidence", "confianca").try_cast("double"), F.lit(0.0))
    unreadable = (text_of(v, "grading_confidence").isNotNull() & given.isNull()) | (text_of(v,
        "confianca").isNotNull() & first("grading_confidence", "confianca").try_cast("double").isNull())
    lists = lambda a, b: F.coalesce(F.try_variant_get(v, f"$.{a}", "array<string>"), F.try_variant_get(v, f"$.{b}", "array<string>"),
        F.array().cast("array<string>"))
    flagged = F.coalesce(first("manual_review_required", "revisao_necessaria").try_cast("boolean"), F.lit(False))
    good = F.struct(
        F.coalesce(first("question_number", "questao").try_cast("int"), question_number).alias("question_number"),
            S.quantize_quarter(cut).alias("score"), F.coalesce(first("justification", "comentario"), F.lit("")).alias("justification"),
        lists("criteria_met", "criterios_atendidos").alias("criteria_met"), lists("criteria_missing", "criterios_ausentes").alias("criteria_missing"),
        F.when(F.isnan(confidence), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0)))).alias("confidence"),
            flagged.alias("flagged"), first("manual_review_reason", "motivo_revisao").alias("flag_reason"),
            (~outside & ~F.isnan(confidence)).alias("parse_ok"),
    )
    none = F.array().cast("array<string>")
    fallback = F.struct(question_number.alias("question_number"), F.lit(0.0).alias("score"), F.lit("").alias("justification"),
        none.alias("criteria_met"), none.alias("criteria_missing"), F.lit(0.0).alias("confidence"), F.lit(True).alias("flagged"),
        F.lit("Falha técnica ou JSON inválido na correção automática.").alias("flag_reason"), F.lit(False).alias("parse_ok"))
    return F.when(~is_object(v) | v.isNull() | x.isNull() | unreadable, fallback).otherwise(good)


def page_grades(pages: DataFrame, questions: DataFrame) -> DataFrame:
    """Grades of whole pages (page_id, exam_id, json with grades): cut to the question's maximum, in quarters; questions without one score 0."""
    listed = pages.withColumn("g", F.explode(F.from_json("json",
        "struct<grades: array<struct<question_number: int, score: double, justification: string>>>")["grades"]))
    given = listed.select("page_id", "exam_id", F.col("g.question_number").alias("question_number"),
        F.coalesce("g.score", F.lit(0.0)).alias("_score"), F.coalesce("g.justification", F.lit("")).alias("justification"))
    known = questions.select("exam_id", "question_number", "max_score")
    graded = given.join(known, ["exam_id", "question_number"], "left").withColumn("score",
        F.greatest(F.lit(0.0), S.quantize_quarter(F.least("_score", F.coalesce("max_score", F.lit(1.0))))))
    absent = pages.select("page_id", "exam_id").join(known.drop("max_score"), "exam_id").join(given.select("page_id", "question_number"),
        ["page_id", "question_number"], "left_anti")
    filled = absent.select("page_id", "exam_id", "question_number", F.lit(0.0).alias("score"), F.lit("").alias("justification"))
    return graded.select("page_id", "exam_id", "question_number", "score", "justification").unionByName(filled)


def vision_page(raw: Column, page_number: Column) -> Column:
    """struct(name, registration, class, student_code, physical_page, questions) of a vision response."""
    v = F.try_parse_json(raw)
    str_of = lambda x, p: F.coalesce(F.try_variant_get(x, f"$.{p}", "string"), F.lit(""))
    listed = F.coalesce(F.try_variant_get(v, "$.questions", "array<variant>"), F.array().cast("array<variant>"))

    def one(q: Column, i: Column) -> Column:
        answer = str_of(q, "answer_transcription")
        region = F.try_variant_get(q, "$.image_region", "variant")
        return F.struct(
            F.coalesce(F.try_variant_get(q, "$.number", "string").try_cast("int"), i + 1).alias("number"),
                str_of(q, "prompt_detected").alias("prompt_detected"), answer.alias("answer_transcription"),
            S.normalize_confidence(F.try_variant_get(q, "$.reading_confidence", "string")).alias("reading_confidence"),
                S.clamp_unit(F.try_variant_get(q, "$.ocr_confidence", "string")).alias("ocr_confidence"),
            str_of(q, "reading_notes").alias("reading_notes"),
                F.coalesce(F.try_variant_get(q, "$.has_answer", "boolean"), answer != "").alias("has_answer"), F.to_json(region).alias("image_region"),
        )

    name, registration = str_of(v, "student.name"), str_of(v, "student.registration")
    page = F.coalesce(F.nullif(text_of(v, "physical_page").try_cast("int"), F.lit(0)), text_of(v, "page_number").try_cast("int"), page_number)
    questions = F.transform(F.filter(listed, is_object), one)
    return F.struct(name.alias("name"), registration.alias("registration"), str_of(v, "student.class").alias("class"),
        T.student_code(str_of(v, "student.student_code"), name, registration).alias("student_code"), page.alias("physical_page"),
        questions.alias("questions"))


def rubric_rows(rubrics: DataFrame) -> DataFrame:
    """exam_id, number, rubric (JSON text) from documents (exam_id, json) in any of three shapes: questions, map, list."""
    v = F.try_parse_json("json")
    items = F.coalesce(F.try_variant_get(v, "$.questions", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    number = lambda x: F.coalesce(*(F.try_variant_get(x, f"$.{k}", "string") for k in ("number", "question_number", "questao"))).try_cast("int")
    listed = F.transform(items, lambda x, i: F.struct(i.alias("pos"), number(x).alias("number"), F.to_json(x).alias("rubric")))
    rows = rubrics.withColumn("_items", listed)
    mapped = F.from_json("json", "map<string, string>")
    pairs = F.transform(F.map_entries(mapped), lambda e, i: F.struct(i.alias("pos"), e["key"].try_cast("int").alias("number"), e["value"].alias("rubric")))
    every = rows.select("exam_id", F.explode(F.coalesce("_items", pairs)).alias("r")).select("exam_id", "r.*").where("number is not null")
    return every.groupBy("exam_id", "number").agg(F.max_by("rubric", "pos").alias("rubric"))


def ocr_result(raw: Column, provider: Column, http_status: Column) -> Column:
    """struct(text, confidence, needs_fallback, provider, error) of a recorded OCR response of either service."""
    word = "struct<confidence: double>"
    block = f"struct<paragraphs: array<struct<words: array<{word}>>>>"
    google = F.from_json(raw, f"struct<responses: array<struct<fullTextAnnotation: struct<text: string, pages: array<struct<blocks: array<{block}>>>>>>>")
    mistral = F.from_json(raw, "struct<pages: array<struct<markdown: string, confidence_scores: struct<average_page_confidence_score: double>>>>")
    note = F.get(google["responses"], 0)["fullTextAnnotation"]
    words = F.flatten(F.transform(F.flatten(F.transform(F.flatten(F.transform(note["pages"],
        lambda p: F.coalesce(p["blocks"], F.array().cast(f"array<{block}>")))),
        lambda b: F.coalesce(b["paragraphs"], F.array().cast(f"array<struct<words: array<{word}>>>")))),
        lambda p: F.transform(F.coalesce(p["words"], F.array().cast(f"array<{word}>")), lambda w: w["confidence"])))
    pages = F.transform(mistral["pages"], lambda p: p["confidence_scores"]["average_page_confidence_score"])
    is_google = provider == "google_vision"
    found = F.filter(F.when(is_google, words).otherwise(pages), lambda c: c.isNotNull())
    mean = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, c: a + c) / F.size(found))
    text = F.when(is_google, F.trim(F.coalesce(note["text"],
        F.lit("")))).otherwise(T.join_texts(F.transform(F.coalesce(mistral["pages"],
        F.array().cast("array<struct<markdown: string, confidence_scores: struct<average_page_confidence_score: double>>>")),
        lambda p: p["markdown"]), "\n\n"))
    name = F.when(is_google, "Google Vision").otherwise("Mistral OCR")
    error = F.when(http_status >= 400, F.concat(name, F.lit(" retornou HTTP "), http_status.cast("string"),
        F.lit("."))).when(F.try_parse_json(raw).isNull(), F.concat(name, F.lit(" retornou JSON inválido.")))
    text, mean = F.when(error.isNull(), text).otherwise(""), F.when(error.isNull(), mean)
    return F.struct(text.alias("text"), mean.alias("confidence"), S.needs_fallback(T.word_count(text), mean).alias("needs_fallback"),
        provider.alias("provider"), error.alias("error"))


def flatten_run(runs: DataFrame) -> DataFrame:
    """Answer rows of run documents: run_id and pages, an array of structs with a student struct and questions with a grade struct."""
    some = lambda c: F.nullif(c, F.lit(""))
    pages = runs.select("run_id", F.explode("pages").alias("p"))
    rows = pages.select("run_id", "p", F.explode("p.questions").alias("q"))
    pick = lambda own, student: F.coalesce(some(F.col(f"p.{own}")), some(F.col(f"p.student.{student}")))
    return rows.select(
        "run_id", pick("detected_student_name", "name").alias("student_name"),
            pick("detected_registration", "registration").alias("registration"),
            pick("detected_student_code", "student_code").alias("detected_student_code"),
        F.coalesce(F.nullif(F.col("p.physical_page"), F.lit(0)), F.nullif(F.col("p.page"), F.lit(0)), F.lit(0)).alias("page_number"),
            F.coalesce("q.number", F.lit(0)).alias("question_number"),
        F.coalesce(some(F.col("q.extracted_answer")), some(F.col("q.answer_transcription"))).alias("answer_transcription"),
            some(F.col("q.reading_confidence")).alias("reading_confidence"), F.col("q.ocr_confidence").alias("ocr_confidence"),
        F.to_json("q.image_region").alias("image_region"), F.col("q.grade.score").alias("score"), some(F.col("q.grade.verdict")).alias("verdict"),
        (F.coalesce("q.grade.needs_human_review", F.lit(False)) | F.coalesce(F.col("q.reading_confidence") == "baixa",
            F.lit(False))).alias("needs_human_review"), some(F.col("q.grade.review_reason")).alias("review_reason"),
    )


def grade_visual_answers(answers: DataFrame) -> DataFrame:
    """The page flow's grade of each answer: no rubric, a rubric of another question, no usable response, or the response's grade.

    answers: question_number, page_number, reading_confidence, has_rubric, guard_ok, response_error, and the
    columns of normalize_grade.
    """
    low = F.col("reading_confidence") == "baixa"
    where = lambda text: F.format_string(text, F.col("question_number"), F.col("page_number"))
    kind = F.when(~F.col("has_rubric"), "sem_rubrica").when(~F.col("guard_ok"), "rubrica_trocada").when(F.col("response_error").isNotNull(),
        "erro").otherwise("corrigida")
    swapped = where("Possível troca de rubrica para question_number=%d (página %d).")
    by = lambda a, b, c, d: F.when(F.col("flow") == "sem_rubrica", a).when(F.col("flow") == "rubrica_trocada",
        b).when(F.col("flow") == "erro", c).otherwise(d)
    return answers.withColumn("flow", kind).withColumns({
        "score": by(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.col("score")),
            "verdict": by(F.lit("sem_rubrica"), F.lit("incorreta"), F.when(low, "ilegivel").otherwise("incorreta"), F.col("verdict")),
        "needs_human_review": by(low, F.lit(True), F.lit(True), F.col("needs_human_review")),
        "review_reason": by(F.when(low, "Leitura visual com baixa confiança.").otherwise(""), swapped,
            F.substring("response_error", 1, 500), F.col("review_reason")),
    })


def with_rubrics(answers: DataFrame, rubrics: DataFrame, number: str = "question_number") -> DataFrame:
    """answers (exam_id, number, ...) with rubric, JSON text: its question's; the exam's whole document where that names no question; else null.

    rubrics has one json an exam_id. Empty documents, and those that are neither object nor array, are none.
    """
    mapped, v = rubric_rows(rubrics).select("exam_id", F.col("number").alias(number), "rubric"), F.try_parse_json("json")
    some = (is_object(v) | is_array(v)) & ~F.to_json(v).isin("{}", "[]")
    whole = rubrics.where(some).join(mapped.select("exam_id").distinct(), "exam_id", "left_anti").select("exam_id", F.col("json").alias("_whole"))
    joined = answers.join(mapped, ["exam_id", number], "left").join(whole, "exam_id", "left")
    return joined.select(*(F.col(f"`{c}`") for c in answers.columns), F.coalesce("rubric", "_whole").alias("rubric"))

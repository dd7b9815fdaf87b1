"""Rules that decide identities, reviews, verdicts and error codes; each a chain of conditions in fixed order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from scoreweave.functions import text as T
from scoreweave.functions.text import let

LOW = 0.70

#: What is said about a page's identity.
FOREIGN_CODE = "QR ignorado por exam_id divergente."
CODE_AGAINST_LIST = "QR e manifest discordam. Usando QR."
CODE_AGAINST_HEADER = "QR e cabeçalho discordam. Usando QR."
HEADER_AGAINST_LIST = "Cabeçalho e manifest discordam. Usando cabeçalho."
BY_LIST = "Identidade via manifest_fallback. Conferir manualmente."
NOBODY = "Nenhuma identidade confiável encontrada."


def _kept(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda w: w.isNotNull())


def pick_identity(qr: Column, header: Column, manifest: Column, exam: Column) -> Column:
    """struct(student_id, identity_source, warnings) of a page: its own code, else header, else manifest, else nobody.

    A code counts when its student is a uuid and its exam is the batch's.
    """

    def chosen(x: Column) -> Column:
        own, head, listed = x["own"], x["head"], x["listed"]
        good = own.isNotNull() & x["same_exam"]
        foreign = F.when(own.isNotNull() & ~good, FOREIGN_CODE)
        by = lambda who, source, *said: F.struct(who.cast("string").alias("student_id"), F.lit(source).alias("identity_source"),
            _kept(*said).alias("warnings"))
        return (
            F.when(good, by(own, "qr", F.when(listed != own, CODE_AGAINST_LIST), F.when(head != own, CODE_AGAINST_HEADER)))
            .when(head.isNotNull(), by(head, "header_ocr", foreign, F.when(listed != head, HEADER_AGAINST_LIST)))
            .when(listed.isNotNull(), by(listed, "manifest_fallback", foreign, F.lit(BY_LIST)))
            .otherwise(by(F.lit(None), "anonymous", foreign, F.lit(NOBODY)))
        )

    def with_own(q: Column) -> Column:
        return F.struct(T.safe_uuid(q["student_id"]).alias("own"), T.safe_uuid(header).alias("head"), T.safe_uuid(manifest).alias("listed"),
            F.coalesce(q["exam_id"] == exam, F.lit(False)).alias("same_exam"))

    return let(let(qr, with_own), chosen)


def review_reason(*, score: Column, confidence: Column, justification: Column, flagged: Column, flag_reason: Column, answer: Column,
    max_score: Column, ocr_error: Column, ocr_confidence: Column, ocr_unstable: Column, parse_failed: Column, visual_ok: Column,
    misaligned: Column) -> Column:
    """Why a grade needs a person, by the first rule that holds; null if none does."""
    true = lambda c: F.coalesce(c, F.lit(False))
    error = F.nullif(ocr_error, F.lit(""))
    plain = F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(true(misaligned), "Falha no alinhamento/crop da página.")
        .when(error.isNotNull() & ~true(visual_ok), F.concat(F.lit("Falha no OCR: "), error))
        .when(true(parse_failed), "Resposta da IA em formato inválido ou nota fora do intervalo.")
        .when((score < 0) | (score > max_score + 1e-6), F.concat(F.lit("Nota fora do intervalo permitido (0–"), max_score.cast("string"), F.lit(").")))
        .when(confidence.isNull() | F.isnan(confidence) | (F.abs(confidence) == float("inf")) | (confidence < LOW),
            "Confiança da correção automática abaixo do limiar (0,70).")
        .when(ocr_confidence < LOW, "Confiança do OCR abaixo do limiar (0,70).")
        .when(~T.has_words(answer, 3), "Texto extraído vazio ou muito curto (menos de 3 palavras).")
        .when(true(ocr_unstable) & ~true(visual_ok), "OCR instável (fallback necessário) e sem transcrição visual alternativa.")
        .when((score <= 0) & (F.length(plain) > 200), "Nota zero com resposta longa — possível erro de leitura ou interpretação.")
        .when(((score < max_score) | (score <= 0)) & (F.trim(F.coalesce(justification, F.lit(""))) == ""),
            "Justificativa obrigatória ausente para nota parcial ou zero.")
        .when(true(flagged), F.coalesce(F.nullif(flag_reason, F.lit("")), F.lit("IA sinalizou revisão manual.")))
    )


def identity_override(scores: DataFrame, default: Column | None = None) -> DataFrame:
    """Scores of pages without a good code are flagged, lose the final score and keep an earlier reason."""
    weak = F.col("identity_source") != "qr"
    text = F.concat(F.lit("Vinculação sem QR confiável ("), F.col("identity_source"), F.lit("). Conferir aluno/página.")) if default is None else default
    return scores.withColumns({
        "requires_manual_review": F.col("requires_manual_review") | weak, "final_score": F.when(~weak, F.col("final_score")),
        "manual_review_reason": F.when(weak, F.coalesce("manual_review_reason", text)).otherwise(F.col("manual_review_reason")),
    })


def needs_visual_grade(ocr_error: Column, ocr_unstable: Column, parse_ok: Column, confidence: Column, flagged: Column) -> Column:
    """Whether a text grade is weak enough to ask for one from the image."""
    return F.nullif(ocr_error, F.lit("")).isNotNull() | F.coalesce(ocr_unstable, F.lit(False)) | ~F.coalesce(parse_ok,
        F.lit(False)) | F.coalesce(confidence < LOW, F.lit(True)) | F.coalesce(flagged, F.lit(False))


def score_answers(answers: DataFrame) -> DataFrame:
    """Each answer's score from its text grade or, where that is weak, its visual grade; then the review rules.

    answers: answer_text, max_score, ocr_error, ocr_confidence, ocr_unstable, misaligned, and the
    structs text_grade and visual_grade of score, confidence, justification, flagged, flag_reason, parse_ok.
    """
    error = F.nullif(F.col("ocr_error"), F.lit(""))
    failed = F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit("").alias("justification"),
        F.lit(True).alias("flagged"), error.alias("flag_reason"), F.lit(True).alias("parse_ok"))
    first = F.when(error.isNotNull(), failed).otherwise(F.col("text_grade"))
    ask = needs_visual_grade(F.col("ocr_error"), F.col("ocr_unstable"), first["parse_ok"], first["confidence"], first["flagged"])
    visual = ask & F.coalesce(F.col("visual_grade.parse_ok"), F.lit(False))
    rows = answers.withColumn("_visual", visual).withColumn("_grade", F.when(visual, F.col("visual_grade")).otherwise(first))
    g = F.col("_grade")
    reason = review_reason(
        score=g["score"], confidence=g["confidence"], justification=g["justification"], flagged=g["flagged"], flag_reason=g["flag_reason"],
            answer=F.col("answer_text"), max_score=F.col("max_score"),
        ocr_error=F.col("ocr_error"), ocr_confidence=F.col("ocr_confidence"), ocr_unstable=F.col("ocr_unstable"),
            parse_failed=~F.coalesce(g["parse_ok"], F.lit(False)), visual_ok=F.col("_visual") | ~F.coalesce("ocr_unstable", F.lit(False)),
            misaligned=F.col("misaligned"),
    )
    out = rows.withColumn("manual_review_reason", reason).withColumn("requires_manual_review", F.col("manual_review_reason").isNotNull())
    return out.withColumns({"ai_score": g["score"], "final_score": F.when(~F.col("requires_manual_review"), g["score"]),
        "used_visual": F.col("_visual")}).drop("_visual", "_grade")


def humanize_reason(warnings: Column, technical: Column, empty_answer: Column | None = None, low_confidence: Column | None = None) -> Column:
    """A friendly reason by the first rule that holds; empty if there is nothing to say."""
    flag = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))

    def chain(said: Column) -> Column:
        has = lambda *words: _any(F.contains(said, F.lit(w)) for w in words)
        return (
            F.when(flag(empty_answer) | has("sem resposta", "resposta vazia"), "Resposta em branco ou não detectada.")
            .when(has("cópia do enunciado", "copia do enunciado"), "Resposta parece cópia do enunciado da questão.")
            .when(has("schema incompleto", "json"), "Falha no formato da resposta da IA. Conferir nota sugerida.")
            .when(has("expecting property name"), "Falha ao interpretar resposta da IA. Revisão manual recomendada.")
            .when(has("identity_source", "manifest_fallback", "sem qr confiável"), "Vinculação do aluno feita sem QR confiável. Conferir aluno.")
            .when(flag(low_confidence) | has("baixa confiança"), "Baixa confiança na leitura da resposta manuscrita.")
            .when(has("off-topic", "fora do tema"), "Resposta fora do tema da questão.")
            .when(F.trim(said) != "", "Revisão manual recomendada.")
            .otherwise("")
        )

    parts = F.concat(F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.coalesce(technical, F.lit(""))))
    return let(F.lower(F.array_join(parts, " | ")), chain)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: The verdicts that a model may give.
VERDICTS = ("correta", "parcial", "incorreta", "sem_resposta", "ilegivel")
ILLEGIBLE = ("[ilegível]", "[ilegivel]")


def normalize_verdict(given: Column, answer: Column, confidence: Column, score: Column) -> Column:
    word, plain = F.lower(F.trim(F.coalesce(given, F.lit("")))), F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(word.isin(*VERDICTS), word).when(plain == "", "sem_resposta")
        .when((confidence == "baixa") & _any(F.contains(plain, F.lit(m)) for m in ILLEGIBLE), "ilegivel")
        .when(score >= 0.99, "correta").when(score > 0, "parcial").otherwise("incorreta")
    )


def count_illegible(answer: Column) -> Column:
    return sum((F.size(F.split(F.coalesce(answer, F.lit("")), m.replace("[", r"\[").replace("]", r"\]"), -1)) - 1 for m in ILLEGIBLE), F.lit(0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null for null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def alike(least: float):
    """Whether two texts' similarity reaches `least`: texts whose letters already rule it out are not compared. Null: no.

    A pair that many rows of a batch share is compared once.
    """

    @F.pandas_udf(BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x, y) -> bool:
            m = SequenceMatcher(None, x, y)
            return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

        known = {pair: one(*pair) for pair in set(zip(a, b, strict=True)) if None not in pair}
        return pd.Series([known.get(pair, False) for pair in zip(a, b, strict=True)], dtype="bool")

    return reaches


def with_copy_flag(answers: DataFrame, answer: str, prompt: str, name: str = "copied") -> DataFrame:
    """Whether an answer copies its prompt: both of 20 characters or more, and tokens shared for 0.85 or texts alike for 0.86.

    A long answer whose start alone has more distinct tokens than such a share of the prompt's allows,
    and is too long to be alike, is no copy, whatever follows; only the others are normalized whole, once.
    Text likeness is only asked for where the lengths allow it and the tokens have not decided.
    """
    text = F.coalesce(F.col(answer), F.lit(""))
    reach = F.length(F.coalesce(F.col(prompt), F.lit(""))) * 2 + 100
    rows = answers.withColumns({"_p": T.normalize_text(F.col(prompt)), "_start": T.normalize_text(F.substr(text, F.lit(1), reach))})
    ended = let(F.split("_start", " "), lambda w: F.size(F.array_distinct(F.slice(w, 1, F.size(w) - 1))))  # the last token may be cut
    other = (F.length(text) > reach) & (ended * 0.85 > F.size(F.split("_p", " "))) & (F.length("_start") > F.length("_p") * (2 / 0.86 - 1))
    rows = rows.withColumn("_other", other).withColumn("_a", F.when(~F.col("_other"), T.normalize_text(F.col(answer))))
    sides = rows.withColumns({"_a": F.when(F.col("_a").isNotNull(), _side(F.col("_a"))), "_p": _side(F.col("_p"))})
    return flag_copies(sides, F.col("_a"), F.col("_p"), name).drop("_a", "_p", "_start", "_other")


def _side(normal: Column) -> Column:
    return F.struct(normal.alias("text"), F.length(normal).alias("length"), F.size(F.array_distinct(F.split(normal, " "))).alias("tokens"))


def copy_side(text: Column) -> Column:
    """struct(text, length, tokens) of a text as the copy rule compares it: normalized, its length and the number of its distinct tokens."""
    return let(T.normalize_text(text), _side)


def flag_copies(rows: DataFrame, a: Column, p: Column, name: str = "copied") -> DataFrame:
    """The rule of with_copy_flag on sides (copy_side) made beforehand, once for a text that many rows share. A null side: no copy.

    Tokens are only compared where their numbers allow such a share.
    """
    la, lp, n = a["length"], p["length"], a["tokens"]
    shares = (n * 0.85 <= p["tokens"]) & (F.size(F.array_intersect(F.split(a["text"], " "), F.split(p["text"], " "))) >= n * 0.85)
    alike_length = F.least(la, lp) * 2 / (la + lp) >= 0.86
    state = F.when(a.isNull() | p.isNull() | (la < 20) | (lp < 20), "no").when(shares, "copy").when(alike_length, "ask").otherwise("no")
    rows = rows.withColumn("_state", state)
    asked = lambda side: F.when(F.col("_state") == "ask", side["text"])
    rows = rows.withColumn("_alike", alike(0.86)(asked(a), asked(p)))
    return rows.withColumn(name, (F.col("_state") == "copy") | F.col("_alike")).drop("_state", "_alike")


def guard_holds(rubrics: DataFrame, guards: DataFrame, text: Column) -> DataFrame:
    """rubrics with guard_ok: one of the number's terms (a table of the exam: question_number, terms) stands in the text, or it has none."""
    joined = rubrics.join(guards, "question_number", "left")
    ok = F.col("terms").isNull() | F.exists("terms", lambda t: F.contains(F.lower(text), t))
    return joined.withColumn("guard_ok", ok).drop("terms")


def error_code(detail: Column) -> Column:
    return let(F.lower(F.coalesce(detail, F.lit(""))), _error_chain)


def _error_chain(low: Column) -> Column:
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("rubrica") & has("troca"), "RUBRIC_MISMATCH")
        .when(has("json") & (has("schema") | has("incompleto") | has("invalid")), "JSON_SCHEMA_INVALID")
        .when(has("render") | (has("pdf") & has("imagem")), "PDF_RENDER_FAILED")
        .when(has("qr"), "QR_READ_FAILED").when(has("transcri"), "TRANSCRIPTION_FAILED").when(has("grading") | has("corre"), "GRADING_FAILED")
        .when(has("database") | has("sql") | has("psycopg"), "DATABASE_ERROR").otherwise("PDF_ANALYSIS_FAILED")
    )


#: Stage and message of each error code.
STAGES = {
    "PDF_RENDER_FAILED": "student_detection", "QR_READ_FAILED": "qr_reading", "TRANSCRIPTION_FAILED": "transcription", "GRADING_FAILED": "grading",
    "JSON_SCHEMA_INVALID": "grading", "RUBRIC_MISMATCH": "grading", "DATABASE_ERROR": "database",
}
MESSAGES = {
    "PDF_RENDER_FAILED": "Não foi possível converter o PDF em imagens.",
    "QR_READ_FAILED": "O QR Code não pôde ser lido em uma ou mais páginas.",
    "STUDENT_LINK_WEAK": "Algumas páginas foram vinculadas por fallback e precisam de revisão.",
    "TRANSCRIPTION_FAILED": "Falha na transcrição visual de uma resposta manuscrita.",
    "GRADING_FAILED": "Falha na correção automática de uma ou mais respostas.",
    "JSON_SCHEMA_INVALID": "A IA retornou uma resposta fora do formato esperado.",
    "DATABASE_ERROR": "Erro ao salvar os resultados no banco.",
    "SELECTED_EXAM_NOT_FOUND": "A prova selecionada não foi encontrada ou não possui gabarito cadastrado.",
    "RUBRIC_MISMATCH": "A rubrica da questão não corresponde à questão detectada.",
    "PDF_ANALYSIS_FAILED": "Não foi possível analisar o PDF.",
}


def _look_up(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def normalize_warning(text: Column) -> Column:
    """struct(code, message, detail, stage) of a warning."""
    low = F.lower(text)
    code = F.when(F.contains(low, F.lit("falha")) | F.contains(low, F.lit("json")), error_code(text)).otherwise("STUDENT_LINK_WEAK")

    def told(c: Column) -> Column:
        message = F.when(c == "STUDENT_LINK_WEAK", text).otherwise(_look_up(MESSAGES, c, MESSAGES["PDF_ANALYSIS_FAILED"]))
        return F.struct(c.alias("code"), message.alias("message"), text.alias("detail"), _look_up(STAGES, c, "unknown").alias("stage"))

    return let(code, told)


def chain_ocr(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, OCR results (rank, text, confidence, needs_fallback, provider, error) of providers in order, as one.

    Each next provider is asked while what is known is an error or unstable; the first good result or
    the first later one with text is taken, else errors are joined. No provider at all: disabled.
    """
    steps = F.array_sort(F.collect_list(F.struct("rank", "text", "confidence", "needs_fallback", "provider", "error")))
    cols = lambda x: [F.coalesce(x["text"], F.lit("")).alias("text"), x["confidence"].alias("confidence"),
        x["needs_fallback"].alias("needs_fallback"), x["provider"].alias("provider"), F.nullif(x["error"], F.lit("")).alias("error")]

    def join(a: Column, b: Column) -> Column:
        good = lambda r: r["error"].isNull() & ~r["needs_fallback"]
        b = F.struct(*cols(b))
        name = F.concat(a["provider"], F.lit("->fallback:"), b["provider"]).alias("provider")
        taken = F.struct(b["text"].alias("text"), b["confidence"].alias("confidence"), b["needs_fallback"].alias("needs_fallback"), name,
            b["error"].alias("error"))
        errors = F.array_join(_kept(a["error"], b["error"]), "; ")
        neither = F.struct(
            F.when(a["text"] != "", a["text"]).otherwise(b["text"]).alias("text"),
                F.coalesce(F.nullif(a["confidence"], F.lit(0.0)), b["confidence"]).alias("confidence"), F.lit(True).alias("needs_fallback"), name,
            F.when(errors != "", errors).otherwise("OCR principal e fallback sem texto confiável.").alias("error"),
        )
        return F.when(good(a), a).when(good(b) | (F.trim(b["text"]) != ""), taken).otherwise(neither)

    listed = results.groupBy(*keys).agg(steps.alias("_steps"))
    known = F.filter("_steps", lambda s: s["provider"].isNotNull())
    nothing = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("needs_fallback"),
        F.lit("disabled").alias("provider"), F.lit("OCR desativado.").alias("error"))
    listed = listed.withColumn("_known", known)
    folded = F.aggregate(F.slice("_known", 2, 1_000_000), F.struct(*cols(F.get("_known", 0))), join)
    return listed.select(*keys, F.when(F.size("_known") > 0, folded).otherwise(nothing).alias("ocr")).select(*keys, "ocr.*")

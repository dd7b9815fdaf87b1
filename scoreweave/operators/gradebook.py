"""Joins and aggregates from question scores to totals, status, statistics and gradebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreweave.functions.scores import effective_score, sheet_score


def with_effective(scores: DataFrame) -> DataFrame:
    return scores.withColumn("effective_score", effective_score(F.col("final_score"), F.col("ai_score")))


def count_with_zero(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Every parent with its number of children, 0 without any."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def result_totals(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Every result with its total effective score, number of scores, and whether any is flagged for review."""
    per = with_effective(scores).groupBy("result_id").agg(F.sum("effective_score").alias("total_score"), F.count("*").alias("n_scores"),
        F.bool_or("requires_manual_review").alias("flagged"))
    joined = results.join(per, "result_id", "left")
    return joined.withColumns({"total_score": F.coalesce("total_score", F.lit(0.0)), "n_scores": F.coalesce("n_scores", F.lit(0)),
        "flagged": F.coalesce("flagged", F.lit(False))})


def result_status(totals: DataFrame) -> DataFrame:
    return totals.withColumn("new_status", F.when(F.col("flagged"), "GRADED").otherwise("AUTO_APPROVED"))


def settle_scores(scores: DataFrame) -> DataFrame:
    """Scores of results without any flag get their model score as final where none is set."""
    flagged = scores.where("requires_manual_review").select("result_id").distinct().withColumn("_held", F.lit(True))
    joined = scores.join(flagged, "result_id", "left")
    return joined.withColumn("final_score",
        F.when(F.col("_held").isNull(), F.coalesce("final_score", "ai_score")).otherwise(F.col("final_score"))).drop("_held")


def batch_status(batches: DataFrame, totals: DataFrame) -> DataFrame:
    per = totals.groupBy("batch_id").agg(F.bool_or("flagged").alias("_flagged"))
    return batches.join(per, "batch_id", "left").withColumn("status", F.when(F.col("_flagged"), "REVIEW_PENDING").otherwise("DONE")).drop("_flagged")


def batch_stats(totals: DataFrame) -> DataFrame:
    is_status = lambda s: F.col("status") == s
    return totals.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(is_status("AUTO_APPROVED")).alias("auto_approved"),
        F.count_if("flagged").alias("pending_review"), F.count_if(is_status("REVIEWED")).alias("reviewed"),
    )


def results_needing_review(results: DataFrame, scores: DataFrame) -> DataFrame:
    return results.join(scores.where("requires_manual_review"), "result_id", "left_semi")


def with_students(results: DataFrame, students: DataFrame) -> DataFrame:
    """Results with their student, or a name and registration made from the page."""
    joined = results.join(students.drop("class_id"), "student_id", "left")
    page = F.col("page_number").cast("string")
    return joined.withColumns({"student_name": F.coalesce("student_name", F.concat(F.lit("Aluno (pág. "), page, F.lit(")"))),
        "registration_number": F.coalesce("registration_number", F.concat(F.lit("P"), page))})


def with_class(exams: DataFrame, classes: DataFrame, missing: str = "—") -> DataFrame:
    return exams.join(classes, "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.lit(missing)))


def final_gradebook(results: DataFrame, scores: DataFrame, questions: DataFrame, batches: DataFrame, students: DataFrame) -> DataFrame:
    """One row per result: the sum of scores over the number of the exam's questions, in quarters."""
    per_exam = questions.groupBy("exam_id").agg(F.count("*").alias("n_questions"))
    known = scores.join(questions.select("question_id"), "question_id", "left_semi")
    totals = result_totals(results, known)
    sheet = totals.join(batches.select("batch_id", "exam_id"), "batch_id").join(per_exam, "exam_id", "left")
    scored = sheet.withColumn("final_score", sheet_score(F.col("total_score"), F.coalesce("n_questions", F.lit(0))))
    named = with_students(scored, students)
    return named.select("batch_id", "result_id", "registration_number", "student_name", F.coalesce("curso", F.lit("")).alias("curso"),
        "final_score", F.when(F.col("flagged"), "sim").otherwise("não").alias("needs_review"))


def pivoted_gradebook(results: DataFrame, scores: DataFrame, numbers: list[int]) -> DataFrame:
    """One column per question number, the latest score of a number winning, with total and status."""
    cells = with_effective(scores).groupBy("result_id").pivot("question_number", numbers).agg(F.max_by("effective_score", "question_id"))
    named = cells.select("result_id", *(F.col(str(n)).alias(f"q{n}") for n in numbers))
    total = sum((F.coalesce(f"q{n}", F.lit(0.0)) for n in numbers), F.lit(0.0))
    return results.join(named, "result_id", "left").withColumn("total_score", total)


def result_details(results: DataFrame, scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Each result with its scores as an array in question order."""
    per = with_effective(scores).join(questions.select("question_id", "max_score"), "question_id")
    nested = per.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("question_number", "ai_score", "final_score",
        "effective_score", "max_score", "requires_manual_review"))).alias("scores"))
    return results.join(nested, "result_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast(nested.schema["scores"].dataType)))


def batch_summary(totals: DataFrame) -> DataFrame:
    t = "total_score"
    return totals.groupBy("batch_id").agg(F.round(F.avg(t), 6).alias("mean_score"), F.max(t).alias("max_score"),
        F.min(t).alias("min_score"), F.round(F.stddev_samp(t), 6).alias("stddev_score"))


def question_difficulty(scores: DataFrame, questions: DataFrame) -> DataFrame:
    joined = with_effective(scores).join(questions.select("question_id", "exam_id", "max_score"), "question_id")
    share = F.col("effective_score") / F.col("max_score")
    return joined.groupBy("exam_id", "question_id").agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("mean_share"),
        F.round(F.count_if(share >= 1) / F.count("*"), 6).alias("full_share"))


def consolidated(results: DataFrame, scores: DataFrame) -> DataFrame:
    totals = result_totals(results, scores)
    return totals.select("result_id", F.coalesce(F.col("student_id").cast("string"),
        F.concat(F.lit("P"), F.col("page_number").cast("string"))).alias("identifier"), "total_score", (~F.col("flagged")).alias("reviewed_by_all"))


def review_queue(results: DataFrame, scores: DataFrame, batches: DataFrame) -> DataFrame:
    """Open flagged results: newest batch first, then page, then id; numbered within each batch and by batch age.

    The position within a batch, the batch's start in its day and the day's start are added up, so that
    no task sorts the whole queue or all batches: only days, of which there are few, stand in one.
    """
    open_ = results_needing_review(results, scores).where(~F.col("status").isin("REVIEWED", "AUTO_APPROVED"))
    dated = open_.join(batches.select("batch_id", "created_at"), "batch_id")
    inside = F.row_number().over(Window.partitionBy("batch_id").orderBy("page_number", "result_id"))
    per = dated.groupBy("created_at", "batch_id").agg(F.count("*").alias("n"))
    per = per.withColumn("day", F.to_date("created_at"))
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = per.groupBy("day").agg(F.sum("n").alias("n")).select(F.col("day").alias("of_day"),
        before(Window.orderBy(F.desc_nulls_last("day"))).alias("day_start"))
    in_day = before(Window.partitionBy("day").orderBy(F.desc("created_at"), "batch_id"))
    starts = per.select("day", "batch_id", in_day.alias("start")).join(days, F.col("day").eqNullSafe(F.col("of_day"))).select("batch_id",
        (F.col("start") + F.col("day_start")).alias("start"))
    return dated.withColumn("inside", inside).join(starts, "batch_id").select("result_id", "batch_id", "page_number", "created_at",
        (F.col("inside") + F.col("start")).alias("position"))


def next_pending(results: DataFrame, scores: DataFrame, batches: DataFrame, n: int = 1) -> DataFrame:
    """The first n of the queue, as a top-n."""
    open_ = results_needing_review(results, scores).where(~F.col("status").isin("REVIEWED", "AUTO_APPROVED"))
    dated = open_.join(batches.select("batch_id", "created_at"), "batch_id")
    return dated.orderBy(F.desc("created_at"), "batch_id", "page_number", "result_id").limit(n).select("result_id", "batch_id", "page_number", "created_at")


def merge_student_pages(pages: DataFrame) -> DataFrame:
    """Pages of one student in a batch as one result; anonymous pages stay alone.

    pages: batch_id, page, student_id, identity_source, detected_name, detected_registration, warnings.
    """
    who = F.coalesce(F.col("student_id").cast("string"), F.concat(F.lit("page-"), F.col("page").cast("string")))
    later_qr = F.bool_or(F.col("identity_source") == "qr")
    first = F.min_by("identity_source", "page")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("page", "warnings"))), lambda p: p["warnings"])
    last = lambda c: F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("page"))).alias(c)
    return pages.groupBy("batch_id", who.alias("student_key")).agg(
        F.min("page").alias("page_number"), F.max("page").alias("physical_page"), last("detected_name"), last("detected_registration"),
        F.when((first == "manifest_fallback") & later_qr, "qr").otherwise(first).alias("identity_source"), F.array_distinct(F.flatten(lists)).alias("warnings"),
    )


def visual_gradebook(answers: DataFrame) -> DataFrame:
    """Answers of a run grouped by code, registration, name or page; the first row by page and question gives the attributes.

    answers: run_id, detected_student_code, registration, student_name, class_name, page_number, question_number, score, needs_human_review, review_reason.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    some = lambda c: F.nullif(text(c), F.lit(""))
    page = F.col("page_number").cast("string")
    key = F.coalesce(some("detected_student_code"), some("registration"), some("student_name"), F.concat(F.lit("pagina-"), page))
    kept = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    rows = answers.withColumns({
        "identity_key": key, "_name": F.coalesce(kept("student_name"), F.concat(F.lit("Aluno (pág. "), page, F.lit(")"))),
        "_reg": F.coalesce(kept("registration"), kept("detected_student_code"), F.concat(F.lit("P"), page)),
            "_class": F.coalesce(F.col("class_name"), F.lit("")),
    })
    order = F.struct("page_number", "question_number")
    per_question = rows.groupBy("run_id", "identity_key", "question_number").agg(
        F.max_by("score", "page_number").alias("score"), F.bool_or("needs_human_review").alias("review"),
        F.min_by(F.struct("_name", "_reg", "_class"), order).alias("who"), F.min(order).alias("first"),
        F.collect_list(F.when(kept("review_reason").isNotNull(), F.struct("page_number", "question_number", "review_reason"))).alias("notes"),
    )
    notes = F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("notes"))), 1, 5), lambda n: n["review_reason"])
    out = per_question.groupBy("run_id", "identity_key").agg(F.min_by("who", "first").alias("who"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.bool_or("review").alias("needs_review"),
        F.array_join(notes, "; ").alias("notes"), F.count("*").alias("n_questions"))
    return out.select("run_id", "identity_key", F.col("who._name").alias("student_name"), F.col("who._reg").alias("registration_number"),
        F.col("who._class").alias("turma"), "total", "needs_review", "notes", "n_questions")


def student_groups(answers: DataFrame) -> DataFrame:
    """Display groups: by code, registration or page, with a label and whether a member fits neither."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    code, registration = text("detected_student_code"), text("registration")
    key = F.coalesce(F.nullif(code, F.lit("")), F.nullif(registration, F.lit("")), F.concat(F.lit("page-"), F.col("page_number").cast("string")))
    base = F.when(code != "", F.concat(F.lit("Aluno "), code)).otherwise(F.coalesce(F.nullif(F.col("student_name"), F.lit("")),
        F.lit("Aluno não identificado")))
    label = F.when(registration != "", F.concat(base, F.lit(" ("), registration, F.lit(")"))).otherwise(base)
    rows = answers.withColumns({"group_key": key, "_label": label, "_other": (code != key) & (registration != key)})
    return rows.groupBy("run_id", "group_key").agg(F.min_by("_label", F.struct("page_number", "question_number")).alias("label"),
        F.count("*").alias("n_answers"), F.bool_or("_other").alias("mismatch"))


def run_summary(pages: DataFrame, default_vision: str, default_text: str) -> DataFrame:
    """pages: run_id, page, vision_model, text_model, warning, error."""
    first = lambda c, d: F.coalesce(F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("page"))), F.lit(d))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("page", c)))), lambda x: x[c])
    out = pages.groupBy("run_id").agg(F.count("*").alias("pages_processed"),
        first(F.col("vision_model"), default_vision).alias("vision_model_used"),
        first(F.col("text_model"), default_text).alias("text_model_used"), listed("warning").alias("warnings"),
        F.array_join(listed("error"), " | ").alias("error"))
    return out.withColumn("status", F.when(F.col("error") == "", "SUCCESS").otherwise("FAILED"))

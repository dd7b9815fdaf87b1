"""Table maintenance as functions of old tables and changes to new tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreweave.operators.ranking import latest_per_key


#: What a load of a roster answers.
LOAD_MESSAGES = {
    "loaded": "{inserted} novos, {updated} atualizados.",
    "too_many_rows": "Máximo {most} alunos.",
    "nothing_changed": "Nenhuma linha de aluno válida encontrada.",
}


def roster_upsert(students: DataFrame, roster: DataFrame) -> DataFrame:
    """students (class_id, registration_number, student_name, curso) after loading roster rows (the same and line).

    The last row of a registration in a roster wins. action: insert, update (name or curso differ) or keep.
    """
    new = latest_per_key(roster, ["class_id", "registration_number"], ["line"]).select("class_id", "registration_number",
        F.col("student_name").alias("_name"), F.col("curso").alias("_curso"), F.lit(True).alias("_new"))
    old = students.withColumn("_old", F.lit(True))
    both = old.join(new, ["class_id", "registration_number"], "full")
    differs = ~F.col("student_name").eqNullSafe(F.col("_name")) | ~F.col("curso").eqNullSafe(F.col("_curso"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new") & differs, "update").otherwise("keep")
    changed = F.col("_new") & (F.col("_old").isNull() | differs)
    out = both.withColumn("action", action).withColumns({"student_name": F.when(changed, F.col("_name")).otherwise(F.col("student_name")),
        "curso": F.when(changed, F.col("_curso")).otherwise(F.col("curso"))})
    return out.drop("_name", "_curso", "_new", "_old")


MOST_ROSTER_ROWS = 2000


@dataclass
class RosterLoad:
    """Tables after a load of rosters, and what became of each: loaded, too_many_rows or nothing_changed."""

    students: DataFrame
    classes: DataFrame
    report: DataFrame


def load_rosters(students: DataFrame, classes: DataFrame, roster: DataFrame, most_rows: int = MOST_ROSTER_ROWS) -> RosterLoad:
    """Rosters of many classes loaded at once, each all or nothing.

    students, roster: as in roster_upsert, the roster's rows with turma besides. classes: class_id,
    class_name. A roster of more than most_rows rows is refused whole: its students and its class stay
    as they are. Of the others, a class that is not there is created, as "Turma" and the first eight
    characters of its id, and takes the name of the first row with a turma, even where no student
    changes, which is reported. students gains action (insert, update, keep), classes gains action
    (create, rename, keep); the report has class_id, n_rows, inserted, updated, outcome and message.
    A null class_id is no class: its rows are loaded nowhere. Repeated registrations count as rows.
    """
    named = roster.where("class_id is not null")
    turma = F.nullif(F.trim("turma"), F.lit(""))
    loads = named.groupBy("class_id").agg(F.count("*").alias("n_rows"), F.min_by(turma, F.when(turma.isNotNull(), F.col("line"))).alias("turma"))
    loads = loads.withColumn("refused", F.col("n_rows") > most_rows)
    rows = named.join(loads.where("refused").select("class_id"), "class_id", "left_anti")
    after = roster_upsert(students, rows.drop("turma"))
    changed = load_counts(after)

    told = loads.where("not refused").select("class_id", "turma", F.lit(True).alias("_loaded"))
    both = classes.withColumn("_there", F.lit(True)).join(told, "class_id", "full")
    created = F.concat(F.lit("Turma "), F.substring(F.col("class_id").cast("string"), 1, 8))
    name = F.when(F.col("_there").isNull(), F.coalesce("turma", created)).otherwise(F.coalesce("turma", "class_name"))
    action = F.when(F.col("_there").isNull(), "create").when(~name.eqNullSafe(F.col("class_name")), "rename").otherwise("keep")
    new_classes = both.withColumns({"action": action, "class_name": name}).drop("_there", "_loaded", "turma")

    outcome = F.when(F.col("refused"), "too_many_rows").when(F.col("inserted") + F.col("updated") == 0, "nothing_changed").otherwise("loaded")
    report = loads.select("class_id", "n_rows", "refused").join(changed, "class_id", "left")
    report = report.withColumns({c: F.when(F.col("refused"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long") for c in ("inserted", "updated")})
    said = F.create_map(*(F.lit(x) for pair in LOAD_MESSAGES.items() for x in pair))
    report = report.withColumn("outcome", outcome).withColumn("message", F.replace(F.replace(F.replace(F.element_at(said, F.col("outcome")),
        F.lit("{most}"), F.lit(str(most_rows))), F.lit("{inserted}"), F.col("inserted").cast("string")), F.lit("{updated}"), F.col("updated").cast("string")))
    return RosterLoad(after, new_classes, report.drop("refused"))


def load_counts(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("class_id").agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"))


def apply_reviews(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """scores (with professor_comment and manual_review_reason) after overrides; the flag and its reason go.

    decisions: decision_id, result_id, question_id, new_score, comment, decided_at. The latest of a
    score sets its final score and comment, and clears a comment that was there. Decisions without a
    question (approvals of a result) or without a score change nothing here.
    """
    own = decisions.where(F.col("question_id").isNotNull() & F.col("new_score").isNotNull())
    last = latest_per_key(own, ["result_id", "question_id"], ["decided_at", "decision_id"])
    out = scores.join(last.select("result_id", "question_id", "new_score", F.col("comment").alias("_comment")), ["result_id", "question_id"], "left")
    decided = F.col("new_score").isNotNull()
    return out.withColumns({
        "final_score": F.coalesce("new_score", "final_score"), "professor_comment": F.when(decided, F.col("_comment")).otherwise(F.col("professor_comment")),
        "requires_manual_review": F.col("requires_manual_review") & ~decided, "manual_review_reason": F.when(~decided, F.col("manual_review_reason")),
    }).drop("new_score", "_comment")


def approve_results(results: DataFrame, scores: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved results are REVIEWED; their flagged scores take the reviewed or the model's score and lose the flag and its reason."""
    mark = approved.select("result_id").distinct().withColumn("_ok", F.lit(True))
    new_results = results.join(mark, "result_id", "left").withColumn("status", F.when(F.col("_ok"), "REVIEWED").otherwise(F.col("status"))).drop("_ok")
    joined = scores.join(mark, "result_id", "left")
    hit = F.coalesce("_ok", F.lit(False)) & F.col("requires_manual_review")
    new_scores = joined.withColumns({
        "final_score": F.when(hit, F.coalesce("final_score", "ai_score")).otherwise(F.col("final_score")),
        "requires_manual_review": F.col("requires_manual_review") & ~hit, "manual_review_reason": F.when(~hit, F.col("manual_review_reason")),
    }).drop("_ok")
    return new_results, new_scores


def apply_decisions(results: DataFrame, scores: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results and scores after overrides and approvals; an approval is a decision without a question."""
    approved = decisions.where(F.col("question_id").isNull())
    return approve_results(results, apply_reviews(scores, decisions), approved)


def clear_batches(results: DataFrame, scores: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and scores without those of the given batches (column batch_id)."""
    gone = results.join(batches.select("batch_id").distinct(), "batch_id", "left_semi").select("result_id")
    return results.join(batches.select("batch_id").distinct(), "batch_id", "left_anti"), scores.join(gone, "result_id", "left_anti")


def delete_exams(tables: dict[str, DataFrame], exams: DataFrame) -> dict[str, DataFrame]:
    """exams, questions, batches, results and scores without the given exams and all that belongs to them."""
    ids = exams.select("exam_id").distinct()
    questions = tables["questions"].join(ids, "exam_id", "left_semi").select("question_id")
    batches = tables["batches"].join(ids, "exam_id", "left_semi").select("batch_id")
    results = tables["results"].join(batches, "batch_id", "left_semi").select("result_id")
    return {
        "exams": tables["exams"].join(ids, "exam_id", "left_anti"), "questions": tables["questions"].join(ids, "exam_id", "left_anti"),
        "batches": tables["batches"].join(ids, "exam_id", "left_anti"), "results": tables["results"].join(batches, "batch_id", "left_anti"),
        "scores": tables["scores"].join(questions, "question_id", "left_anti").join(results, "result_id", "left_anti"),
    }


def unlink_classes(students: DataFrame, results: DataFrame, exams: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Students of the given classes go; results lose them, exams lose the class."""
    ids = classes.select("class_id").distinct()
    gone = students.join(ids, "class_id", "left_semi").select("student_id").withColumn("_gone", F.lit(True))
    new_results = results.join(gone, "student_id", "left").withColumn("student_id", F.when(F.col("_gone").isNull(), F.col("student_id"))).drop("_gone")
    mark = ids.withColumn("_gone", F.lit(True))
    new_exams = exams.join(mark, "class_id", "left").withColumn("class_id", F.when(F.col("_gone").isNull(), F.col("class_id"))).drop("_gone")
    return students.join(ids, "class_id", "left_anti"), new_results, new_exams


#: What a request to process a batch again does in each status.
REPROCESS = {"FAILED": "reset", "DONE": "reset", "REVIEW_PENDING": "reset", "PENDING": "reset", "PROCESSING": "refused"}
PROCESS_NOW = {"FAILED": "reset", "DONE": "skipped", "REVIEW_PENDING": "skipped", "PENDING": "reset", "PROCESSING": "refused"}


def reprocess_outcome(status: Column, transitions: dict[str, str], exam: Column | None = None, other_exam: Column | None = None) -> Column:
    """reset, refused or skipped; a re-upload for another exam is refused."""
    table = F.create_map(*(F.lit(x) for pair in transitions.items() for x in pair))
    out = F.coalesce(F.try_element_at(table, status), F.lit("refused"))
    return out if exam is None else F.when(exam == other_exam, out).otherwise("refused")


def reprocess(batches: DataFrame, requests: DataFrame, transitions: dict[str, str]) -> DataFrame:
    """batches (batch_id, exam_id, status, total_pages) after requests (batch_id, exam_id); reset ones are PENDING with no pages."""
    asked = requests.select("batch_id", F.col("exam_id").alias("_exam")).distinct()
    out = batches.join(asked, "batch_id", "left")
    outcome = F.when(F.col("_exam").isNotNull(), reprocess_outcome(F.col("status"), transitions, F.col("exam_id"), F.col("_exam")))
    out = out.withColumn("outcome", outcome)
    reset = F.coalesce(F.col("outcome") == "reset", F.lit(False))
    return out.withColumns({"status": F.when(reset, "PENDING").otherwise(F.col("status")),
        "total_pages": F.when(reset, F.lit(0)).otherwise(F.col("total_pages"))}).drop("_exam")


def evolve(df: DataFrame, columns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """df with the columns (type, default) that it lacks; nulls of a column with a default get it."""
    for name, (kind, default) in columns.items():
        held = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, held if default is None else F.coalesce(held, default.cast(kind)))
    return df

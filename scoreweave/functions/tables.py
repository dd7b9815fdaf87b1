"""Operators as table functions of Spark SQL: SELECT ... FROM sw_roster_upsert(12).

A table function shows what an operator gives for tables of the session. Its parameters name key
columns: a value keeps the rows that have it, a null or nothing keeps all. They are SQL functions that
the optimizer inlines, so a condition goes down to the scans as far as the operator lets it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.functions import text as T
from scoreweave.operators import gradebook as G
from scoreweave.operators import maintain as M
from scoreweave.operators import responses as P
from scoreweave.operators import rules as R
from scoreweave.sources import files as L


def register_table_function(spark: SparkSession, name: str, rows: DataFrame, keys: list[str]) -> str:
    """A temporary table function of the given rows with a parameter for each key (key => value); its name."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if missing := [k for k in keys if k not in kinds]:
        raise ValueError(f"{name}: no such columns {missing}")
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    view = f"{name}_rows"
    rows.createOrReplaceTempView(view)
    asked = ", ".join(f"{quoted(k)} {kinds[k]} DEFAULT NULL" for k in keys)
    columns = ", ".join(f"{quoted(c)} {kind}" for c, kind in kinds.items())
    kept = " AND ".join(f"({name}.{quoted(k)} IS NULL OR v.{quoted(k)} = {name}.{quoted(k)})" for k in keys) or "true"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({asked}) RETURNS TABLE({columns}) RETURN SELECT {', '.join(f'v.{quoted(c)}' for c in kinds)} FROM {view} v WHERE {kept}")
    return name


def _identities(pages: DataFrame) -> DataFrame:
    """pages: exam_id (text), qr_payload, header_student, manifest_student and more columns."""
    who = R.pick_identity(T.parse_qr(F.col("qr_payload")), F.col("header_student"), F.col("manifest_student"), F.col("exam_id"))
    return pages.withColumn("_who", who).select(*pages.columns, "_who.student_id", "_who.identity_source", F.col("_who.warnings").alias("identity_warnings"))


def _exam_questions(exam_texts: DataFrame) -> DataFrame:
    return L.read_exam_lines(L.text_lines(exam_texts, "exam_id", "text"), "exam_id")


def _grades(responses: DataFrame) -> DataFrame:
    """responses: result_id, question_number, max_score, raw (the model's text)."""
    grade = P.parse_single_grade(F.col("raw"), F.col("question_number"), F.col("max_score"))
    return responses.select("result_id", F.col("question_number").alias("asked_number"), grade.alias("_g")).select("result_id", "asked_number", "_g.*")


#: Function: the tables that it takes, in the order of the operator's arguments; the operator; its parameters.
OPERATORS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame], list[str]]] = {
    "pick_identity": (("pages",), _identities, ["exam_id"]),
    "parse_exam_lines": (("exam_texts",), _exam_questions, ["exam_id"]),
    "parse_single_grade": (("responses",), _grades, ["result_id"]),
    "identity_override": (("page_scores",), R.identity_override, ["result_id"]),
    "score_answers": (("graded_answers",), R.score_answers, ["result_id"]),
    "roster_upsert": (("students", "roster"), M.roster_upsert, ["class_id"]),
    "roster_classes": (("students", "classes", "roster"), lambda *t: M.load_rosters(*t).classes, ["class_id"]),
    "roster_report": (("students", "classes", "roster"), lambda *t: M.load_rosters(*t).report, ["class_id"]),
    "apply_score_review": (("scores", "decisions"), M.apply_reviews, ["result_id"]),
    "approved_results": (("results", "scores", "approved"), lambda *t: M.approve_results(*t)[0], ["batch_id"]),
    "batch_results_cleared": (("results", "scores", "cleared"), lambda *t: M.clear_batches(*t)[0], ["batch_id"]),
    "reprocess_batches": (("batches", "requests"), lambda b, r: M.reprocess(b, r, M.REPROCESS), ["batch_id"]),
    "result_totals": (("results", "scores"), G.result_totals, ["batch_id", "result_id"]),
    "review_queue": (("results", "scores", "batches"), G.review_queue, ["batch_id"]),
}


def register_operators(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "sw_") -> list[str]:
    """Table functions of all operators whose tables are given; their names.

    The tables are those of the Column and DataFrame operators of the same names, with their columns.
    """
    out = []
    for name, (needs, operator, keys) in OPERATORS.items():
        if all(n in tables for n in needs):
            rows = operator(*(tables[n] for n in needs))
            out.append(register_table_function(spark, prefix + name, rows, [k for k in keys if k in rows.columns]))
    return out

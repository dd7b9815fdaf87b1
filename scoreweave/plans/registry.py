"""Registered queries, and the SQL over the driver's tables that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreweave.sources.tables import Grading

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The bound tables as SQL; see scoreweave.sources.tables.
_GRADE = "(CASE WHEN {x} IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, ceil(({x}) * 4 - 0.5) / 4)) END)"
BOUND = {
    "classes": "SELECT n_nationkey AS class_id, n_name AS class_name FROM nation",
    "students": """SELECT c_custkey AS student_id, c_nationkey AS class_id, c_name AS student_name, string_split(c_name,
'#')[-1] AS registration_number, c_mktsegment AS curso FROM customer""",
    "exams": "SELECT s_suppkey AS exam_id, s_nationkey AS class_id, s_name AS exam_name FROM supplier",
    "questions": """SELECT e.exam_id * 10 + n AS question_id, e.exam_id, n::INT AS question_number, a.text AS question_text,
b.text AS expected_answer, 1.0::DOUBLE AS max_score
        FROM exams e CROSS JOIN range(1, 8) r(n) JOIN benchmark a ON a.item_id = (e.exam_id * 10 + n) % (SELECT count(*) FROM benchmark)
JOIN benchmark b ON b.item_id = (e.exam_id * 10 + n + 1) % (SELECT count(*) FROM benchmark)""",
    "batches": """SELECT o_orderkey // 75 AS batch_id, (o_orderkey // 75) % (SELECT count(*)
FROM supplier) AS exam_id, min(o_orderdate) AS created_at, count(*) AS total_pages FROM orders GROUP BY ALL""",
    "results": """SELECT o_orderkey AS result_id, o_orderkey // 75 AS batch_id, CASE
WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS student_id, (o_orderkey % 75 + 1)::INT AS page_number,
        CASE o_orderstatus WHEN 'F' THEN 'AUTO_APPROVED' WHEN 'O' THEN 'GRADED' ELSE 'REVIEWED' END AS status FROM orders""",
    "raw_scores": f"""SELECT l_orderkey AS result_id, ((l_orderkey // 75) % (SELECT count(*)
FROM supplier)) * 10 + l_linenumber AS question_id, l_linenumber AS question_number, {_GRADE.format(x='l_discount * 10')} AS ai_score,
        CASE WHEN l_returnflag <> 'N' THEN {_GRADE.format(x='l_discount * 10')} END AS final_score,
l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity >= 49 AS requires_manual_review,
        round(1 - l_tax * 5, 2) AS ocr_confidence, round(0.5 + l_quantity / 100, 2) AS grading_confidence, l_partkey AS v1, l_suppkey AS v2,
l_extendedprice AS v3 FROM lineitem""",
    "scores": "SELECT * FROM raw_scores QUALIFY row_number() OVER (PARTITION BY result_id, question_id ORDER BY v1 DESC, v2 DESC, v3 DESC) = 1",
    "answers": """SELECT s.*, q.question_text, q.expected_answer, q.max_score, CASE WHEN s.v1 % 23 = 0 THEN q.question_text
ELSE coalesce(d.text, '') END AS answer_text
        FROM scores s JOIN questions q USING (question_id) LEFT JOIN documents d ON d.doc_id = s.v1""",
    "effective": "SELECT *, coalesce(final_score, ai_score, 0.0) AS effective_score FROM scores",
    "totals": """SELECT r.*, coalesce(t.total_score, 0.0) AS total_score, coalesce(t.n_scores, 0) AS n_scores, coalesce(t.flagged, false) AS flagged
        FROM results r LEFT JOIN (SELECT result_id, sum(effective_score) AS total_score, count(*) AS n_scores,
bool_or(requires_manual_review) AS flagged FROM effective GROUP BY 1) t USING (result_id)""",
}
_NEEDS = {"questions": ["exams"], "scores": ["raw_scores"], "answers": ["scores", "questions"], "effective": ["scores"], "totals": ["results", "effective"]}


def bound_sql(sql: str, *tables: str) -> str:
    """sql with the bound tables that it names, and what they need, as common table expressions."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for n in _NEEDS.get(name, []):
            want(n)
        if name not in wanted:
            wanted.append(name)

    for t in tables:
        want(t)
    if not wanted:
        return sql.strip()
    heads = ", ".join(f"{t} AS ({BOUND[t]})" for t in wanted)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads}, {body[len(start) :]}"
    return f"WITH {heads} {body}"


def query(tables: str = "", sql: str | None = None):
    """Register a function of the bound tables under its name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Grading(spark, folder))
        if sql is not None:
            ORACLES[fn.__name__] = bound_sql(sql, *tables.split())
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from scoreweave.plans import gradebook, responses, rules, sheets, streams  # noqa: F401




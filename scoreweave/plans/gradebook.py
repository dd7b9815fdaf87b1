"""Queries over scores, results and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreweave.functions import scores as S
from scoreweave.functions import text as T
from scoreweave.operators import gradebook as G
from scoreweave.operators import maintain as M
from scoreweave.operators import ranking as R
from scoreweave.plans.registry import query
from scoreweave.sources.stored import GradingStore
from scoreweave.sources.work import work_folder

# --- scans, filters, projections


@query("", """SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*)
FROM lineitem""")
def scan_tables(g):
    parts = [g.raw(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("nation", "customer", "supplier", "orders", "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("results", "SELECT result_id, student_id, page_number, status FROM results WHERE batch_id = 3")
def lookup_by_key(g):
    return g.results().where(F.col("batch_id") == 3).select("result_id", "student_id", "page_number", "status")


@query("classes exams", "SELECT e.exam_id, c.class_id FROM exams e JOIN classes c ON lower(c.class_name) = lower('Nation_' || (e.exam_id % 25))")
def class_by_name_ci(g):
    wanted = g.exams().select("exam_id", F.lower(F.concat(F.lit("Nation_"), (F.col("exam_id") % 25).cast("string"))).alias("name"))
    return wanted.join(g.classes().withColumn("name", F.lower("class_name")), "name").select("exam_id", "class_id")


@query("scores", "SELECT result_id, question_id, ai_score FROM scores WHERE requires_manual_review")
def pending_scores(g):
    return g.scores().where("requires_manual_review").select("result_id", "question_id", "ai_score")


@query("scores", "SELECT result_id, question_id, ai_score FROM scores WHERE NOT requires_manual_review")
def auto_scores(g):
    return g.scores().where(~F.col("requires_manual_review")).select("result_id", "question_id", "ai_score")


@query("effective", "SELECT result_id, question_id, effective_score FROM effective")
def effective_score(g):
    return G.with_effective(g.scores()).select("result_id", "question_id", "effective_score")


@query("effective questions results", """SELECT r.result_id, count(q.question_id) AS n_scores,
coalesce(string_agg(e.question_number || ':' || e.effective_score, ',' ORDER BY e.question_number), '') AS scores FROM results r LEFT
JOIN effective e USING (result_id) LEFT JOIN questions q USING (question_id) GROUP BY 1""")
def result_detail(g):
    out = G.result_details(g.results(), g.scores(), g.questions())
    shown = F.array_join(F.transform("scores", lambda s: F.concat_ws(":", s["question_number"].cast("string"), s["effective_score"].cast("string"))), ",")
    return out.select("result_id", F.size("scores").cast("long").alias("n_scores"), shown.alias("scores"))


# --- joins


@query("results scores", "SELECT r.result_id, s.question_id, r.batch_id, s.ai_score FROM results r JOIN scores s USING (result_id)")
def results_scores(g):
    return g.results().join(g.scores(), "result_id").select("result_id", "question_id", "batch_id", "ai_score")


@query("results students", """SELECT r.result_id, coalesce(s.student_name, 'Aluno (pág. ' || r.page_number || ')') AS student_name,
coalesce(s.registration_number, 'P' || r.page_number) AS registration_number FROM results r LEFT JOIN students s USING (student_id)""")
def results_students(g):
    return G.with_students(g.results(), g.students()).select("result_id", "student_name", "registration_number")


@query("scores questions", """SELECT s.result_id, s.question_id, s.ai_score, q.max_score FROM scores s JOIN questions q USING (question_id)
WHERE q.question_number <> 4""")
def scores_questions(g):
    left = g.questions().where(F.col("question_number") != 4).select("question_id", "max_score")
    return g.scores().join(left, "question_id").select("result_id", "question_id", "ai_score", "max_score")


@query("exams classes", """SELECT e.exam_id, e.exam_name, coalesce(c.class_name, '—') AS class_name FROM exams e LEFT JOIN (SELECT *
FROM classes WHERE class_id % 2 = 0) c USING (class_id)""")
def exam_class(g):
    return G.with_class(g.exams(), g.classes().where(F.col("class_id") % 2 == 0)).select("exam_id", "exam_name", "class_name")


@query("results batches", "SELECT r.result_id, b.batch_id, b.exam_id, b.created_at FROM results r JOIN batches b USING (batch_id)")
def results_batches(g):
    return g.results().join(g.batches(), "batch_id").select("result_id", "batch_id", "exam_id", "created_at")


@query("results scores", "SELECT result_id, batch_id FROM results WHERE result_id IN (SELECT result_id FROM scores WHERE requires_manual_review)")
def results_needing_review(g):
    return G.results_needing_review(g.results(), g.scores()).select("result_id", "batch_id")


# --- aggregates


@query("exams questions", "SELECT e.exam_id, e.exam_name, count(q.question_id) AS n_questions FROM exams e LEFT JOIN questions q USING (exam_id) GROUP BY ALL")
def exam_question_count(g):
    return G.count_with_zero(g.exams().select("exam_id", "exam_name"), g.questions(), "exam_id", "n_questions").orderBy("exam_name")


@query("classes students", """SELECT c.class_id, c.class_name, count(s.student_id) AS n_students FROM classes c LEFT
JOIN students s USING (class_id) GROUP BY ALL""")
def class_student_count(g):
    return G.count_with_zero(g.classes(), g.students(), "class_id", "n_students").orderBy("class_name")


@query("totals", "SELECT result_id, total_score, n_scores FROM totals")
def result_total(g):
    return G.result_totals(g.results(), g.scores()).select("result_id", "total_score", "n_scores")


@query("totals", "SELECT result_id, CASE WHEN flagged THEN 'GRADED' ELSE 'AUTO_APPROVED' END AS new_status FROM totals")
def result_status(g):
    return G.result_status(G.result_totals(g.results(), g.scores())).select("result_id", "new_status")


@query("scores totals", """SELECT s.result_id, s.question_id, CASE WHEN t.flagged THEN s.final_score
ELSE coalesce(s.final_score, s.ai_score) END AS final_score FROM scores s JOIN (SELECT result_id, bool_or(requires_manual_review) AS flagged
FROM scores GROUP BY 1) t USING (result_id)""")
def settled_scores(g):
    return G.settle_scores(g.scores()).select("result_id", "question_id", "final_score")


@query("batches totals", """SELECT b.batch_id, CASE WHEN bool_or(t.flagged) THEN 'REVIEW_PENDING' ELSE 'DONE' END AS status FROM batches b
LEFT JOIN totals t USING (batch_id) GROUP BY 1""")
def batch_status(g):
    return G.batch_status(g.batches(), G.result_totals(g.results(), g.scores())).select("batch_id", "status")


@query("totals", """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'AUTO_APPROVED') AS auto_approved,
count(*) FILTER (flagged) AS pending_review, count(*) FILTER (status = 'REVIEWED') AS reviewed FROM totals GROUP BY 1""")
def batch_stats(g):
    return G.batch_stats(G.result_totals(g.results(), g.scores()))


@query("scores", "SELECT count(DISTINCT result_id) AS remaining FROM scores WHERE requires_manual_review")
def remaining_reviews(g):
    return g.scores().where("requires_manual_review").agg(F.count_distinct("result_id").alias("remaining"))


@query("results effective", "SELECT r.result_id, r.status, " + ", ".join(f"max(effective_score) FILTER (question_number = {n}) AS q{n}" for n in range(1,
    8)) + ", coalesce(sum(effective_score), 0.0) AS total_score FROM results r LEFT JOIN effective e USING (result_id) GROUP BY 1, 2")
def gradebook_pivot(g):
    return G.pivoted_gradebook(g.results().select("result_id", "status"), g.scores(), list(range(1, 8)))


_FINAL = """SELECT t.batch_id, t.result_id, coalesce(s.registration_number, 'P' || t.page_number) AS registration_number,
coalesce(s.student_name, 'Aluno (pág. ' || t.page_number || ')') AS student_name,
    coalesce(s.curso, '') AS curso, round_even(t.total_score / 7 * 4, 0) / 4 AS final_score, CASE WHEN t.flagged THEN 'sim'
ELSE 'não' END AS needs_review FROM totals t LEFT JOIN students s USING (student_id)"""


@query("totals students", _FINAL)
def gradebook_final(g):
    return G.final_gradebook(g.results(), g.scores(), g.questions(), g.batches(), g.students())


@query("totals", "SELECT result_id, round_even(total_score / 7 * 4, 0) / 4 AS final_score FROM totals")
def final_score_mean(g):
    totals = G.result_totals(g.results(), g.scores())
    exam = g.questions().groupBy("exam_id").agg(F.count("*").alias("n_questions"))
    sheet = totals.join(g.batches().select("batch_id", "exam_id"), "batch_id").join(exam, "exam_id", "left")
    return sheet.select("result_id", S.sheet_score(F.col("total_score"), F.coalesce("n_questions", F.lit(0))).alias("final_score"))


@query("questions exams", "SELECT e.exam_id, count(q.question_id) >= 7 AS full FROM exams e LEFT JOIN questions q USING (exam_id) GROUP BY 1")
def exam_question_limit(g):
    counted = G.count_with_zero(g.exams().select("exam_id"), g.questions(), "exam_id", "n")
    return counted.select("exam_id", (F.col("n") >= 7).alias("full"))


@query("totals", """SELECT batch_id, round(avg(total_score), 6) AS mean_score, max(total_score) AS max_score,
min(total_score) AS min_score, round(stddev_samp(total_score), 6) AS stddev_score FROM totals GROUP BY 1""")
def batch_summary(g):
    return G.batch_summary(G.result_totals(g.results(), g.scores()))


@query("effective questions", """SELECT q.exam_id, question_id, count(*) AS n, round(avg(effective_score / q.max_score), 6) AS mean_share,
round(count(*) FILTER (effective_score >= q.max_score) / count(*), 6) AS full_share FROM effective e JOIN questions q USING (question_id)
GROUP BY 1, 2""")
def question_difficulty(g):
    return G.question_difficulty(g.scores(), g.questions())


@query("totals", "SELECT result_id, coalesce(student_id::VARCHAR, 'P' || page_number) AS identifier, total_score, NOT flagged AS reviewed_by_all FROM totals")
def final_scores(g):
    return G.consolidated(g.results(), g.scores())


@query("scores", "SELECT result_id, list_sort(list(DISTINCT question_number)) AS numbers FROM scores GROUP BY 1")
def distinct_question_numbers(g):
    return g.scores().groupBy("result_id").agg(F.array_sort(F.collect_set("question_number")).alias("numbers"))


@query("results", "SELECT batch_id, list_sort(list(DISTINCT page_number)) AS pages FROM results GROUP BY 1")
def distinct_source_pages(g):
    return g.results().groupBy("batch_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))


# --- ranking


@query("scores", "SELECT result_id, question_id, v1, v2, v3 FROM scores")
def dedupe_scores_latest(g):
    return R.latest_per_key(g.raw_scores(), ["result_id", "question_id"], ["v1", "v2", "v3"]).select("result_id", "question_id", "v1", "v2", "v3")


@query("raw_scores", """SELECT result_id, question_id, v1, v2, v3 FROM raw_scores QUALIFY row_number() OVER (PARTITION BY result_id,
question_id ORDER BY v1, v2, v3) = 1""")
def first_score_per_question(g):
    return R.first_per_key(g.raw_scores(), ["result_id", "question_id"], ["v1", "v2", "v3"]).select("result_id", "question_id", "v1", "v2", "v3")


@query("raw_scores", """SELECT result_id, question_id, v1 FROM (SELECT *, row_number() OVER (PARTITION BY result_id
ORDER BY v1, v2, v3) AS n FROM raw_scores) WHERE n <= 3""")
def top_n_per_group(g):
    return R.top_per_group(g.raw_scores(), ["result_id"], [F.col("v1"), F.col("v2"), F.col("v3")], 3).select("result_id", "question_id", "v1")


@query("questions", """SELECT question_id, row_number() OVER (PARTITION BY exam_id ORDER BY question_number) AS question_number
FROM questions WHERE question_number <> 3""")
def renumber_questions(g):
    left = g.questions().where(F.col("question_number") != 3).select("question_id", "exam_id", F.col("question_number").alias("old"))
    return R.numbered(left, ["exam_id"], [F.col("old")], "question_number").select("question_id",
        F.col("question_number").cast("long").alias("question_number"))


_OPEN = """SELECT r.result_id, r.batch_id, r.page_number, b.created_at FROM results r JOIN batches b USING (batch_id)
WHERE r.status NOT IN ('REVIEWED', 'AUTO_APPROVED') AND r.result_id IN (SELECT result_id FROM scores WHERE requires_manual_review)"""


@query("results batches scores", f"SELECT * FROM ({_OPEN}) ORDER BY created_at DESC, batch_id, page_number, result_id LIMIT 1")
def next_pending_review(g):
    return G.next_pending(g.results(), g.scores(), g.batches())


@query("results batches scores", f"SELECT *, row_number() OVER (ORDER BY created_at DESC, batch_id, page_number, result_id) AS position FROM ({_OPEN})")
def review_queue(g):
    return G.review_queue(g.results(), g.scores(), g.batches())


@query("students", "SELECT class_id, student_id, student_name FROM students")
def ordered_lists(g):
    return g.students().select("class_id", "student_id", "student_name").orderBy("student_name", "student_id")


# --- pages and display groups over bound rows

_VISUAL = """visual AS (SELECT result_id % 97 AS run_id, CASE WHEN v1 % 5 = 0 THEN ''
ELSE lpad((result_id % 40)::VARCHAR, 3, '0') END AS detected_student_code, CASE WHEN v1 % 3 = 0 THEN NULL
ELSE 'R' || (result_id % 50) END AS registration,
    CASE WHEN v1 % 4 = 0 THEN '' ELSE 'Aluno ' || (result_id % 60) END AS student_name, NULL::VARCHAR AS class_name,
result_id AS page_number, question_number, ai_score AS score, requires_manual_review AS needs_human_review, CASE
WHEN v1 % 6 = 0 THEN 'motivo ' || (v1 % 9) END AS review_reason FROM scores)"""


def _visual(g):
    r, v = F.col("result_id"), F.col("v1")
    return g.scores().select(
        (r % 97).alias("run_id"), F.when(v % 5 == 0, "").otherwise(F.lpad((r % 40).cast("string"), 3, "0")).alias("detected_student_code"),
        F.when(v % 3 != 0, F.concat(F.lit("R"), (r % 50).cast("string"))).alias("registration"),
            F.when(v % 4 == 0, "").otherwise(F.concat(F.lit("Aluno "), (r % 60).cast("string"))).alias("student_name"),
        F.lit(None).cast("string").alias("class_name"), r.alias("page_number"), "question_number", F.col("ai_score").alias("score"),
            F.col("requires_manual_review").alias("needs_human_review"),
        F.when(v % 6 == 0, F.concat(F.lit("motivo "), (v % 9).cast("string"))).alias("review_reason"),
    )


@query("scores", f"""WITH {_VISUAL},
k AS (SELECT *, coalesce(nullif(trim(detected_student_code), ''), nullif(trim(registration), ''), nullif(trim(student_name), ''),
'pagina-' || page_number) AS identity_key FROM visual),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, identity_key ORDER BY page_number, question_number) AS pos FROM k WHERE review_reason IS NOT NULL),
notes AS (SELECT run_id, identity_key, string_agg(review_reason, '; ' ORDER BY pos) AS notes FROM n WHERE pos <= 5 GROUP BY 1, 2),
q AS (SELECT run_id, identity_key, question_number, arg_max(score, page_number) AS score FROM k GROUP BY 1, 2, 3),
t AS (SELECT run_id, identity_key, coalesce(sum(score), 0.0) AS total, count(*) AS n_questions FROM q GROUP BY 1, 2),
f AS (SELECT run_id, identity_key, coalesce(nullif(student_name, ''), 'Aluno (pág. ' || page_number || ')') AS student_name,
coalesce(nullif(registration, ''), nullif(detected_student_code, ''), 'P' || page_number) AS registration_number, coalesce(class_name,
'') AS turma
      FROM k QUALIFY row_number() OVER (PARTITION BY run_id, identity_key ORDER BY page_number, question_number) = 1),
r AS (SELECT run_id, identity_key, bool_or(needs_human_review) AS needs_review FROM k GROUP BY 1, 2)
SELECT f.*, t.total, r.needs_review, coalesce(notes.notes, '') AS notes, t.n_questions FROM f JOIN t USING (run_id, identity_key)
JOIN r USING (run_id, identity_key) LEFT JOIN notes USING (run_id, identity_key)""")
def visual_gradebook(g):
    return G.visual_gradebook(_visual(g))


@query("scores", f"""WITH {_VISUAL},
k AS (SELECT *, trim(coalesce(detected_student_code, '')) AS code, trim(coalesce(registration, '')) AS reg FROM visual),
g AS (SELECT *, coalesce(nullif(code, ''), nullif(reg, ''), 'page-' || page_number) AS group_key, CASE WHEN code <> '' THEN 'Aluno ' || code
ELSE coalesce(nullif(student_name, ''), 'Aluno não identificado') END || CASE WHEN reg <> '' THEN ' (' || reg || ')' ELSE '' END AS label
FROM k)
SELECT run_id, group_key, arg_min(label, (page_number, question_number)) AS label, count(*) AS n_answers,
bool_or(code <> group_key AND reg <> group_key) AS mismatch FROM g GROUP BY 1, 2""")
def student_groups(g):
    return G.student_groups(_visual(g))


_PAGES = """pages AS (SELECT batch_id, page_number AS page, student_id % 50 AS student_id, CASE result_id % 3 WHEN 0 THEN 'qr'
WHEN 1 THEN 'manifest_fallback' ELSE 'header_ocr' END AS identity_source,
    CASE WHEN result_id % 4 = 0 THEN NULL ELSE 'Nome ' || (result_id % 7) END AS detected_name, CASE
WHEN result_id % 5 = 0 THEN 'M' || result_id END AS detected_registration,
    CASE WHEN result_id % 2 = 0 THEN ['aviso a', 'aviso ' || (result_id % 3)] ELSE [] END AS warnings FROM results)"""


def _pages(g):
    r = F.col("result_id")
    return g.results().select(
        "batch_id", F.col("page_number").alias("page"), (F.col("student_id") % 50).alias("student_id"),
            F.when(r % 3 == 0, "qr").when(r % 3 == 1, "manifest_fallback").otherwise("header_ocr").alias("identity_source"),
        F.when(r % 4 != 0, F.concat(F.lit("Nome "), (r % 7).cast("string"))).alias("detected_name"),
            F.when(r % 5 == 0, F.concat(F.lit("M"), r.cast("string"))).alias("detected_registration"),
        F.when(r % 2 == 0, F.array(F.lit("aviso a"),
            F.concat(F.lit("aviso "), (r % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


@query("results", f"""WITH {_PAGES}, k AS (SELECT *, coalesce(student_id::VARCHAR, 'page-' || page) AS student_key FROM pages),
w AS (SELECT batch_id, student_key, list(w ORDER BY first) AS warnings FROM (SELECT batch_id, student_key, w, min(page * 10 + i) AS first
FROM (SELECT batch_id, student_key, page, unnest(warnings) AS w, generate_subscripts(warnings, 1) AS i FROM k) GROUP BY 1, 2, 3)
GROUP BY 1, 2)
SELECT k.batch_id, k.student_key, min(page) AS page_number, max(page) AS physical_page, arg_max(detected_name,
page) FILTER (detected_name IS NOT NULL) AS detected_name, arg_max(detected_registration,
page) FILTER (detected_registration IS NOT NULL) AS detected_registration,
CASE WHEN arg_min(identity_source, page) = 'manifest_fallback' AND bool_or(identity_source = 'qr') THEN 'qr'
ELSE arg_min(identity_source, page) END AS identity_source, coalesce(any_value(w.warnings), []) AS warnings FROM k LEFT
JOIN w USING (batch_id, student_key) GROUP BY 1, 2""")
def merge_student_pages(g):
    return G.merge_student_pages(_pages(g))


@query("results", f"WITH {_PAGES} SELECT batch_id, page, len(list_distinct(warnings || ['aviso a', 'novo'])) AS n FROM pages")
def warnings_union(g):
    both = F.array_distinct(F.concat("warnings", F.array(F.lit("aviso a"), F.lit("novo"))))
    return _pages(g).select("batch_id", "page", F.size(both).cast("long").alias("n"))


@query("results", f"""WITH {_PAGES}, p AS (SELECT batch_id, page, CASE WHEN page % 3 = 0 THEN 'visao-' || (page % 4)
ELSE '' END AS vision_model, CASE WHEN page % 5 = 0 THEN 'texto-' || page END AS text_model, CASE
WHEN page % 20 = 1 THEN 'aviso ' || page END AS warning, CASE WHEN batch_id % 4 = 0 AND page % 30 = 2 THEN 'erro ' || page END AS error
FROM pages)
SELECT batch_id AS run_id, count(*) AS pages_processed, coalesce(arg_min(nullif(vision_model, ''), page) FILTER (nullif(vision_model,
'') IS NOT NULL), 'v') AS vision_model_used, coalesce(arg_min(text_model, page) FILTER (text_model IS NOT NULL), 't') AS text_model_used,
coalesce(list(warning ORDER BY page) FILTER (warning IS NOT NULL), []) AS warnings, coalesce(string_agg(error, ' | '
ORDER BY page), '') AS error, CASE WHEN count(error) = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM p GROUP BY 1""")
def run_summary(g):
    p = F.col("page")
    named = lambda word, x: F.concat(F.lit(word), x.cast("string"))
    pages = _pages(g).select(
        F.col("batch_id").alias("run_id"), "page", F.when(p % 3 == 0, named("visao-", p % 4)).otherwise("").alias("vision_model"),
            F.when(p % 5 == 0, named("texto-", p)).alias("text_model"),
        F.when(p % 20 == 1, named("aviso ", p)).alias("warning"), F.when((F.col("batch_id") % 4 == 0) & (p % 30 == 2), named("erro ", p)).alias("error"),
    )
    return G.run_summary(pages, "v", "t")


# --- maintenance

_ROSTER = """roster AS (SELECT class_id, registration_number, CASE WHEN student_id % 6 = 0 THEN student_name || ' Filho'
ELSE student_name END AS student_name, curso, 1 AS line FROM students WHERE student_id % 3 = 0
    UNION ALL SELECT class_id, 'N' || registration_number, student_name, curso, 2 FROM students WHERE student_id % 10 = 0
UNION ALL SELECT class_id, 'N' || registration_number, student_name || ' 2', curso, 3 FROM students WHERE student_id % 20 = 0)"""


def _roster(g):
    s, i = g.students().drop("student_id"), F.col("student_id")
    base = g.students()
    cols = lambda reg, name, line: [F.col("class_id"), reg.alias("registration_number"), name.alias("student_name"), F.col("curso"),
        F.lit(line).alias("line")]
    new = F.concat(F.lit("N"), F.col("registration_number"))
    first = base.where(i % 3 == 0).select(*cols(F.col("registration_number"),
        F.when(i % 6 == 0, F.concat("student_name", F.lit(" Filho"))).otherwise(F.col("student_name")), 1))
    return s, first.union(base.where(i % 10 == 0).select(*cols(new, F.col("student_name"),
        2))).union(base.where(i % 20 == 0).select(*cols(new, F.concat("student_name", F.lit(" 2")), 3)))


_UPSERT = f"""WITH {_ROSTER}, r AS (SELECT * FROM roster QUALIFY row_number() OVER (PARTITION BY class_id, registration_number ORDER BY line DESC) = 1),
u AS (SELECT coalesce(s.class_id, r.class_id) AS class_id, coalesce(s.registration_number, r.registration_number) AS registration_number,
coalesce(r.student_name, s.student_name) AS student_name, coalesce(r.curso, s.curso) AS curso,
CASE WHEN s.class_id IS NULL THEN 'insert'
WHEN r.class_id IS NOT NULL AND (s.student_name <> r.student_name OR s.curso <> r.curso) THEN 'update' ELSE 'keep' END AS action
FROM students s FULL JOIN r ON s.class_id = r.class_id AND s.registration_number = r.registration_number)"""


@query("students", f"{_UPSERT} SELECT * FROM u")
def roster_upsert(g):
    return M.roster_upsert(*_roster(g))


@query("students", f"""{_UPSERT} SELECT class_id, count(*) FILTER (action = 'insert') AS inserted,
count(*) FILTER (action = 'update') AS updated FROM u GROUP BY 1""")
def roster_load_counts(g):
    return M.load_counts(M.roster_upsert(*_roster(g)))


_LOADS = """base AS (SELECT *, (row_number() OVER (PARTITION BY class_id ORDER BY student_id))::INT AS line FROM students),
loads AS (SELECT class_id, registration_number, CASE WHEN class_id % 6 <> 2 AND student_id % 6 = 0 THEN student_name || ' Filho' ELSE student_name END AS student_name,
curso, CASE WHEN class_id % 4 = 0 AND line > 2 THEN ' T' || class_id || ' ' ELSE '' END AS turma, line FROM base WHERE line <= 40
UNION ALL SELECT class_id + 1000, registration_number, student_name, curso, CASE WHEN class_id % 2 = 0 THEN 'Nova ' || class_id END, line FROM base WHERE line <= 3
UNION ALL SELECT class_id, 'X' || i, 'Aluno', 'C', 'Grande', 100000 + i::INT FROM classes CROSS JOIN range(2001) r(i) WHERE class_id % 6 = 1),
sizes AS (SELECT class_id, count(*) AS n_rows, arg_min(trim(turma), line) FILTER (trim(turma) <> '') AS turma, count(*) > 2000 AS refused FROM loads GROUP BY 1),
last AS (SELECT * FROM loads JOIN sizes USING (class_id) WHERE NOT refused QUALIFY row_number() OVER (PARTITION BY class_id, registration_number ORDER BY line DESC) = 1)"""
_LOAD_ACTION = """CASE WHEN s.class_id IS NULL THEN 'insert' WHEN s.student_name IS DISTINCT FROM l.student_name OR s.curso IS DISTINCT FROM l.curso THEN 'update' ELSE 'keep' END"""


def _loaded(g):
    """Rosters of forty students of each class: some renamed, some classes named, every sixth unchanged, every sixth with 2001 rows too many, and new classes."""
    base = g.students().withColumn("line", F.row_number().over(Window.partitionBy("class_id").orderBy("student_id")))
    c, line = F.col("class_id"), F.col("line")
    cols = ("class_id", "registration_number", "student_name", "curso", "turma", "line")
    renamed = F.when((c % 6 != 2) & (F.col("student_id") % 6 == 0), F.concat("student_name", F.lit(" Filho"))).otherwise(F.col("student_name"))
    named = F.when((c % 4 == 0) & (line > 2), F.concat(F.lit(" T"), c.cast("string"), F.lit(" "))).otherwise("")
    first = base.where(line <= 40).withColumn("student_name", renamed).withColumn("turma", named).select(*cols)
    new = base.where(line <= 3).withColumn("turma", F.when(c % 2 == 0, F.concat(F.lit("Nova "), c.cast("string")))).withColumn("class_id", c + 1000).select(*cols)
    i = F.explode(F.sequence(F.lit(0), F.lit(2000))).alias("i")
    large = g.classes().where(c % 6 == 1).select("class_id", i).select("class_id", F.concat(F.lit("X"), F.col("i").cast("string")).alias("registration_number"),
        F.lit("Aluno").alias("student_name"), F.lit("C").alias("curso"), F.lit("Grande").alias("turma"), (F.col("i") + 100_000).alias("line"))
    return M.load_rosters(g.students().drop("student_id"), g.classes(), first.unionByName(new).unionByName(large))


@query("students classes", f"""WITH {_LOADS}, u AS (SELECT l.class_id, {_LOAD_ACTION} AS action FROM last l
LEFT JOIN students s ON s.class_id = l.class_id AND s.registration_number = l.registration_number),
n AS (SELECT class_id, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated FROM u GROUP BY 1)
SELECT z.class_id, z.n_rows, coalesce(inserted, 0) AS inserted, coalesce(updated, 0) AS updated,
CASE WHEN refused THEN 'too_many_rows' WHEN inserted + updated = 0 THEN 'nothing_changed' ELSE 'loaded' END AS outcome,
CASE WHEN refused THEN 'Máximo 2000 alunos.' WHEN inserted + updated = 0 THEN 'Nenhuma linha de aluno válida encontrada.'
ELSE inserted || ' novos, ' || updated || ' atualizados.' END AS message FROM sizes z LEFT JOIN n USING (class_id)""")
def roster_load_report(g):
    return _loaded(g).report


@query("students classes", f"""WITH {_LOADS} SELECT coalesce(c.class_id, z.class_id) AS class_id, CASE WHEN c.class_id IS NULL
THEN coalesce(z.turma, 'Turma ' || left(z.class_id::VARCHAR, 8)) ELSE coalesce(z.turma, c.class_name) END AS class_name,
CASE WHEN c.class_id IS NULL THEN 'create' WHEN z.turma IS NOT NULL AND z.turma <> c.class_name THEN 'rename' ELSE 'keep' END AS action
FROM classes c FULL JOIN (SELECT * FROM sizes WHERE NOT refused) z ON c.class_id = z.class_id""")
def roster_load_classes(g):
    return _loaded(g).classes


@query("students classes", f"""WITH {_LOADS} SELECT coalesce(s.class_id, l.class_id) AS class_id, coalesce(s.registration_number, l.registration_number) AS registration_number,
coalesce(l.student_name, s.student_name) AS student_name, coalesce(l.curso, s.curso) AS curso,
CASE WHEN l.class_id IS NULL THEN 'keep' ELSE {_LOAD_ACTION} END AS action
FROM students s FULL JOIN last l ON s.class_id = l.class_id AND s.registration_number = l.registration_number""")
def roster_load_students(g):
    return _loaded(g).students


_DECISIONS = """decisions AS (SELECT event_id AS decision_id, user_id AS result_id, CASE
WHEN event_id % 4 > 0 THEN ((user_id // 75) % (SELECT count(*) FROM supplier)) * 10 + event_id % 7 + 1 END AS question_id,
CASE WHEN event_id % 4 > 0 THEN greatest(0.0, least(1.0, ceil(value / 100 * 4 - 0.5) / 4)) END AS new_score, CASE
WHEN event_id % 3 > 0 THEN 'nota ' || event_id END AS comment, ts AS decided_at FROM events)"""


def decisions(g, events):
    """Every fourth event approves a result, the others override a score; some have a comment."""
    user, event = F.col("user_id"), F.col("event_id")
    question = (F.floor(user / 75) % g.n_exams * 10 + event % 7 + 1).cast("long")
    override = event % 4 > 0
    return events.select(
        event.alias("decision_id"), user.alias("result_id"), F.when(override, question).alias("question_id"),
            F.when(override, S.clamp_grade((F.col("value") / 100).cast("string"))["score"]).alias("new_score"),
        F.when(event % 3 > 0, F.concat(F.lit("nota "), event.cast("string"))).alias("comment"), F.col("ts").cast("timestamp").alias("decided_at"),
    )


def reviewable(g):
    """Scores with a comment on every fifth and a reason where they are flagged."""
    return g.scores().withColumns({"professor_comment": F.when(F.col("v1") % 5 == 0, "antes"),
        "manual_review_reason": F.when(F.col("requires_manual_review"), "motivo")})


_REVIEWED = f"""WITH {_DECISIONS}, s AS (SELECT *, CASE WHEN v1 % 5 = 0 THEN 'antes' END AS professor_comment, CASE
WHEN requires_manual_review THEN 'motivo' END AS manual_review_reason FROM scores),
d AS (SELECT * FROM decisions WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id, question_id
ORDER BY decided_at DESC, decision_id DESC) = 1),
reviewed AS (SELECT s.result_id, s.question_id, s.ai_score, coalesce(d.new_score, s.final_score) AS final_score, CASE
WHEN d.decision_id IS NULL THEN s.professor_comment ELSE d.comment END AS professor_comment,
s.requires_manual_review AND d.decision_id IS NULL AS requires_manual_review, CASE
WHEN d.decision_id IS NULL THEN s.manual_review_reason END AS manual_review_reason FROM s LEFT JOIN d USING (result_id, question_id))"""
_SCORE_STATE = ("result_id", "question_id", "final_score", "professor_comment", "requires_manual_review", "manual_review_reason")


@query("scores", f"{_REVIEWED} SELECT {', '.join(_SCORE_STATE)} FROM reviewed")
def apply_score_review(g):
    return M.apply_reviews(reviewable(g), decisions(g, g.raw("events"))).select(*_SCORE_STATE)


_DECIDED = f"""{_REVIEWED}, ok AS (SELECT DISTINCT result_id, true AS ok FROM decisions WHERE question_id IS NULL),
decided AS (SELECT result_id, question_id, CASE WHEN ok AND requires_manual_review THEN coalesce(final_score, ai_score)
ELSE final_score END AS final_score, professor_comment,
requires_manual_review AND ok IS NULL AS requires_manual_review, CASE WHEN ok IS NULL THEN manual_review_reason END AS manual_review_reason,
CASE WHEN ok THEN 'REVIEWED' ELSE status END AS status
FROM reviewed JOIN results USING (result_id) LEFT JOIN ok USING (result_id))"""


def decided(g, given):
    results, scores = M.apply_decisions(g.results(), reviewable(g), given)
    return scores.select(*_SCORE_STATE).join(results.select("result_id", "status"), "result_id")


@query("results scores", """WITH s AS (SELECT *, result_id % 2 = 0 AND requires_manual_review AS hit FROM scores)
SELECT r.result_id, CASE WHEN r.result_id % 2 = 0 THEN 'REVIEWED' ELSE r.status END AS status, coalesce(sum(CASE
WHEN hit THEN coalesce(final_score, ai_score) ELSE coalesce(final_score, ai_score, 0.0) END), 0.0) AS total_score,
coalesce(bool_or(requires_manual_review AND NOT hit), false) AS flagged, count(*) FILTER (requires_manual_review AND NOT hit) AS n_reasons
FROM results r LEFT JOIN s USING (result_id) GROUP BY 1, 2""")
def approve_results(g):
    approved = g.results().where(F.col("result_id") % 2 == 0).select("result_id")
    results, scores = M.approve_results(g.results(), reviewable(g), approved)
    reasons = scores.groupBy("result_id").agg(F.count("manual_review_reason").alias("n_reasons"))
    totals = G.result_totals(results, scores).select("result_id", "status", "total_score", "flagged")
    return totals.join(reasons, "result_id", "left").withColumn("n_reasons", F.coalesce("n_reasons", F.lit(0).cast("long")))


@query("results scores", """SELECT r.batch_id, count(DISTINCT r.result_id) AS n_results, count(s.question_id) AS n_scores FROM results r
LEFT JOIN scores s USING (result_id) WHERE r.batch_id % 5 <> 0 GROUP BY 1""")
def clear_batch(g):
    results, scores = M.clear_batches(g.results(), g.scores(), g.batches().where(F.col("batch_id") % 5 == 0))
    n = scores.groupBy("result_id").agg(F.count("*").alias("n"))
    return results.join(n, "result_id", "left").groupBy("batch_id").agg(F.count("*").alias("n_results"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_scores"))


def _store(g, batches=None):
    """The bound tables as stored tables of a hundred batches a partition."""
    folder = work_folder(g.spark, "store")
    return GradingStore(g.spark, folder, 100).create(g.batches() if batches is None else batches, g.results(), g.scores())


def _left(store):
    """n_results and n_scores of every batch that is still there, from the store's files."""
    n = store.scores.read().groupBy("batch_id").agg(F.count("*").alias("n_scores"))
    results = store.results.read().groupBy("batch_id").agg(F.count("*").alias("n_results"))
    return results.join(n, "batch_id", "left").select("batch_id", "n_results", F.coalesce("n_scores", F.lit(0).cast("long")).alias("n_scores"))


@query("results scores", """WITH n AS (SELECT r.batch_id, count(DISTINCT r.result_id) AS n_results, count(s.question_id) AS n_scores
FROM results r LEFT JOIN scores s USING (result_id) GROUP BY 1), gone AS (SELECT * FROM n WHERE batch_id % 5 = 0 OR batch_id // 100 = 1)
SELECT batch_id, n_results, n_scores FROM n WHERE batch_id % 5 <> 0 AND batch_id // 100 <> 1
UNION ALL SELECT -1, coalesce(sum(n_results), 0), coalesce(sum(n_scores), 0) FROM gone UNION ALL SELECT -2, 0, 0""")
def stored_clear_batch(g):
    """Every fifth batch and a whole partition cleared in stored tables; batch -1 has what was removed, -2 what a second run removed."""
    store = _store(g)
    gone = g.batches().where((F.col("batch_id") % 5 == 0) | (F.floor(F.col("batch_id") / 100) == 1))
    counts = [store.clear_batches(gone) for _ in range(2)]
    told = [(-1 - i, n["results"], n["scores"]) for i, n in enumerate(counts)]
    return _left(store).union(g.spark.createDataFrame(told, "batch_id long, n_results long, n_scores long"))


@query("exams batches results scores", """WITH gone AS (SELECT batch_id FROM batches WHERE exam_id IN (2, 5)),
n AS (SELECT count(*) FILTER (batch_id NOT IN (SELECT batch_id FROM gone)) AS n_left, count(*) FILTER (batch_id IN (SELECT batch_id FROM gone)) AS n_gone,
'batches' AS name FROM batches
UNION ALL SELECT count(*) FILTER (batch_id NOT IN (SELECT batch_id FROM gone)), count(*) FILTER (batch_id IN (SELECT batch_id FROM gone)), 'results' FROM results
UNION ALL SELECT count(*) FILTER (result_id // 75 NOT IN (SELECT batch_id FROM gone)), count(*) FILTER (result_id // 75 IN (SELECT batch_id FROM gone)), 'scores'
FROM scores JOIN results USING (result_id)) SELECT * FROM n""")
def stored_cascade_delete_exam(g):
    store = _store(g)
    gone = store.delete_exams(g.exams().where(F.col("exam_id").isin(2, 5)))
    left = {"batches": store.batches, "results": store.results, "scores": store.scores}
    parts = [t.read().agg(F.count("*").alias("n_left")).select(F.lit(n).alias("name"), "n_left", F.lit(gone[n]).cast("long").alias("n_gone")) for n, t in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("results students", """SELECT r.result_id, CASE WHEN s.class_id = 5 THEN NULL ELSE r.student_id END AS student_id FROM results r
LEFT JOIN students s USING (student_id)""")
def stored_unlink_class(g):
    store = _store(g)
    store.unlink_students(g.students().where("class_id = 5"))
    return store.results.read().select("result_id", "student_id")


@query("exams questions batches results scores", """SELECT 'exams' AS name, count(*) AS n FROM exams WHERE exam_id NOT IN (2, 5)
UNION ALL SELECT 'questions', count(*) FROM questions WHERE exam_id NOT IN (2, 5)
UNION ALL SELECT 'batches', count(*) FROM batches WHERE exam_id NOT IN (2, 5) UNION ALL SELECT 'results', count(*) FROM results
WHERE batch_id % (SELECT count(*) FROM supplier) NOT IN (2, 5) UNION ALL SELECT 'scores', count(*) FROM scores
WHERE (result_id // 75) % (SELECT count(*) FROM supplier) NOT IN (2, 5)""")
def cascade_delete_exam(g):
    tables = {"exams": g.exams(), "questions": g.questions(), "batches": g.batches(), "results": g.results(), "scores": g.scores()}
    left = M.delete_exams(tables, g.exams().where(F.col("exam_id").isin(2, 5)))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("results students", """SELECT r.result_id, CASE WHEN s.class_id % 5 = 0 THEN NULL ELSE r.student_id END AS student_id FROM results r
LEFT JOIN students s USING (student_id)""")
def unlink_class(g):
    _, results, _ = M.unlink_classes(g.students(), g.results(), g.exams(), g.classes().where(F.col("class_id") % 5 == 0))
    return results.select("result_id", "student_id")


_STATUS = "CASE batch_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DONE' WHEN 2 THEN 'REVIEW_PENDING' WHEN 3 THEN 'PENDING' ELSE 'PROCESSING' END"


@query("batches", f"""WITH b AS (SELECT batch_id, exam_id, total_pages, {_STATUS} AS status FROM batches), a AS (SELECT *, CASE
WHEN batch_id % 3 = 0 THEN CASE WHEN batch_id % 4 = 0 THEN 'refused' WHEN status = 'PROCESSING' THEN 'refused'
ELSE 'reset' END END AS outcome FROM b)
SELECT batch_id, exam_id, CASE WHEN outcome = 'reset' THEN 'PENDING' ELSE status END AS status, CASE WHEN outcome = 'reset' THEN 0
ELSE total_pages END AS total_pages, outcome FROM a""")
def reprocess_batches(g):
    b = F.col("batch_id")
    status = F.when(b % 5 == 0, "FAILED").when(b % 5 == 1, "DONE").when(b % 5 == 2, "REVIEW_PENDING").when(b % 5 == 3, "PENDING").otherwise("PROCESSING")
    batches = g.batches().select("batch_id", "exam_id", "total_pages").withColumn("status", status)
    requests = batches.where(b % 3 == 0).select("batch_id", F.when(b % 4 == 0, F.col("exam_id") + 100).otherwise(F.col("exam_id")).alias("exam_id"))
    return M.reprocess(batches, requests, M.REPROCESS)


@query("batches results scores", f"""WITH b AS (SELECT batch_id, exam_id, total_pages, {_STATUS} AS status, batch_id % 3 = 0 AND batch_id % 4 <> 0 AND batch_id % 5 <> 4 AS reset FROM batches)
SELECT b.batch_id, CASE WHEN reset THEN 'PENDING' ELSE b.status END AS status, CASE WHEN reset THEN 0 ELSE total_pages END AS total_pages,
count(DISTINCT r.result_id) FILTER (NOT reset) AS n_results, count(s.question_id) FILTER (NOT reset) AS n_scores
FROM b LEFT JOIN results r USING (batch_id) LEFT JOIN scores s USING (result_id) GROUP BY ALL""")
def stored_reprocess_batches(g):
    b = F.col("batch_id")
    status = F.when(b % 5 == 0, "FAILED").when(b % 5 == 1, "DONE").when(b % 5 == 2, "REVIEW_PENDING").when(b % 5 == 3, "PENDING").otherwise("PROCESSING")
    batches = g.batches().select("batch_id", "exam_id", "total_pages").withColumn("status", status)
    store = _store(g, batches)
    store.reprocess(batches.where(b % 3 == 0).select("batch_id", F.when(b % 4 == 0, F.col("exam_id") + 100).otherwise(F.col("exam_id")).alias("exam_id")))
    zero = F.lit(0).cast("long")
    out = store.batches.read().join(_left(store), "batch_id", "left")
    return out.select("batch_id", "status", "total_pages", F.coalesce("n_results", zero).alias("n_results"), F.coalesce("n_scores", zero).alias("n_scores"))


@query("results", "SELECT result_id, status, '[]' AS warnings_json, false AS requires_manual_review, NULL::INT AS physical_page FROM results")
def evolve_schema(g):
    out = M.evolve(g.results().select("result_id", "status"),
        {"warnings_json": ("string", F.lit("[]")), "requires_manual_review": ("boolean", F.lit(False)), "physical_page": ("int", None)})
    return out


# --- scalar functions over the customer and order tables


@query("", "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents")
def word_count(g):
    return g.raw("documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"))


@query("", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9áàâãéèêíïóôõöúçñ\\s]', ' ', 'g'),
'\\s+', ' ', 'g'))) AS normal FROM documents""")
def normalize_text(g):
    return g.raw("documents").select("doc_id", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("normal"))


@query("", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'x7' WHEN o_orderkey % 4 = 1 THEN printf('%03d',
(o_orderkey % 1000)::INT) WHEN o_orderkey % 4 = 2 THEN printf('%03d', (100 + o_orderkey % 800)::INT) ELSE '' END AS code FROM orders""")
def student_code(g):
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 0, " x7 ")
    name = F.when(k % 4 == 1, F.concat(F.lit("aluno n. "), (k % 1000).cast("string"), F.lit(" a"))).otherwise("sem codigo")
    registration = F.when(k % 4 == 2, F.concat(F.lit("RA-"), (100 + k % 800).cast("string")))
    return g.raw("orders").select("o_orderkey", T.student_code(code, name, registration).alias("code"))


@query("", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey % 10) END AS exam_id, CASE
WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 4)::INT END AS page FROM orders""")
def parse_qr_payload(g):
    k = F.col("o_orderkey")
    good = T.format_qr(F.concat(F.lit("e"), (k % 10).cast("string")), k.cast("string"), (k % 4).cast("string"), F.lit("4"))
    raw = F.when(k % 3 == 0, good).when(k % 3 == 1, F.concat(F.lit("XX|"), good)).otherwise("MQPC|a|b|c|d")
    qr = T.parse_qr(raw)
    return g.raw("orders").select("o_orderkey", qr["exam_id"].alias("exam_id"), qr["page"].alias("page"))


@query("", "SELECT o_orderkey, 'MQPC|' || (o_orderkey % 10) || '|' || o_custkey || '|1|2' AS payload FROM orders")
def format_qr_payload(g):
    return g.raw("orders").select("o_orderkey",
        T.format_qr((F.col("o_orderkey") % 10).cast("string"), F.col("o_custkey").cast("string"), F.lit("1"), F.lit("2")).alias("payload"))


@query("", "SELECT o_orderkey, round_even(o_orderkey % 100 / 16.0 * 4, 0) / 4 AS q FROM orders")
def quantize_quarter(g):
    return g.raw("orders").select("o_orderkey", S.quantize_quarter(F.col("o_orderkey") % 100 / 16).alias("q"))


@query("", """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 40 / 32.0 END AS x FROM orders)
SELECT o_orderkey, CASE WHEN x IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, ceil(x * 4 - 0.5) / 4)) END AS score,
x IS NULL OR greatest(0.0, least(1.0, ceil(x * 4 - 0.5) / 4)) <> x AS invalid FROM v""")
def clamp_grade(g):
    k = F.col("o_orderkey")
    grade = S.clamp_grade(F.when(k % 11 == 0, "abc").otherwise(F.replace((k % 40 / 32).cast("string"), F.lit("."), F.lit(","))))
    return g.raw("orders").select("o_orderkey", grade["score"].alias("score"), grade["invalid"].alias("invalid"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.5 ELSE o_orderkey % 100 / 10.0 END::DOUBLE AS x FROM orders")
def parse_score_comma(g):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "sem nota").otherwise(F.replace((k % 100 / 10).cast("string"), F.lit("."), F.lit(",")))
    return g.raw("orders").select("o_orderkey", S.parse_decimal(text, F.lit(1.5)).alias("x"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE least(1.0, o_orderkey % 100 / 64.0) END::DOUBLE AS x FROM orders")
def clamp_unit(g):
    k = F.col("o_orderkey")
    return g.raw("orders").select("o_orderkey", S.clamp_unit(F.when(k % 5 == 0, "nada").otherwise((k % 100 / 64).cast("string"))).alias("x"))


@query("", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'media' ELSE 'baixa' END AS c FROM orders")
def normalize_confidence(g):
    k = F.col("o_orderkey") % 5
    return g.raw("orders").select("o_orderkey",
        S.normalize_confidence(F.when(k == 0, " Alta ").when(k == 1, "MÉDIA").when(k == 2, "medio").when(k == 3, "certa")).alias("c"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '550e8400-e29b-41d4-a716-' || lpad(o_orderkey::VARCHAR, 12, '0') END AS id FROM orders")
def safe_uuid(g):
    k = F.col("o_orderkey")
    good = F.concat(F.lit("550E8400-E29B-41D4-A716-"), F.lpad(k.cast("string"), 12, "0"))
    raw = F.when(k % 4 == 0, F.concat(F.lit(" {"), good, F.lit("} "))).when(k % 2 == 0,
        F.concat(F.lit("urn:uuid:"), F.replace(good, F.lit("-"), F.lit("")))).otherwise(F.substr(good, F.lit(2)))
    return g.raw("orders").select("o_orderkey", T.safe_uuid(raw).alias("id"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Prova de ' || o_orderkey WHEN 1 THEN 'Prova discursiva' WHEN 2 THEN 'a.b'
ELSE 'Prova discursiva' END AS title FROM orders""")
def title_from_filename(g):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Prova_de_"), k.cast("string"), F.lit(".docx"))).when(k % 4 == 1, "___").when(k % 4 == 2, "a.b.PDF").otherwise("")
    return g.raw("orders").select("o_orderkey", T.title_from_filename(name).alias("title"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'nota ' || o_orderkey || '.pdf' WHEN 1 THEN 'a_' || o_orderkey || '.PDF'
WHEN 2 THEN o_orderkey || '.docx.pdf' ELSE 'pasta.pdf' END AS pdf FROM orders""")
def safe_pdf_name(g):
    k, s = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("/tmp/x/nota "), s)).when(k == 1, F.concat(F.lit("a\\"), s, F.lit(".PDF"))).when(k == 2,
        F.concat(s, F.lit(".docx"))).otherwise("/tmp/pasta/")
    return g.raw("orders").select("o_orderkey", T.safe_pdf_name(name).alias("pdf"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'nota ' || o_orderkey WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN ''
WHEN 3 THEN 'a' || chr(10) || '```' || chr(10) || o_orderkey WHEN 4 THEN 'x ```' || o_orderkey || '```'
ELSE '{' || o_orderkey || '}' END AS inner_text FROM orders""")
def strip_code_fence(g):
    k, s = F.col("o_orderkey") % 6, F.col("o_orderkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\nnota "), s, F.lit("\n```"))).when(k == 1, F.concat(F.lit(" "), s, F.lit("\n"))).when(k == 2,
            F.concat(F.lit("``` "), s))
        .when(k == 3, F.concat(F.lit("  ```\na\n```\n"), s, F.lit("\n``` fim "))).when(k == 4,
            F.concat(F.lit("x ```"), s, F.lit("```"))).otherwise(F.concat(F.lit("```\n{"), s, F.lit("}")))
    )
    return g.raw("orders").select("o_orderkey", T.strip_code_fence(raw).alias("inner_text"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' || chr(10) || o_orderkey ELSE 'a' END AS t FROM orders")
def append_text(g):
    k = F.col("o_orderkey")
    return g.raw("orders").select("o_orderkey", T.join_texts(F.array(F.lit(" a "), F.lit(""), F.when(k % 2 == 0, k.cast("string")))).alias("t"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[\"c' || o_orderkey || '\"]' END AS j FROM orders")
def criteria_json(g):
    k = F.col("o_orderkey")
    return g.raw("orders").select("o_orderkey",
        T.criteria_json(F.when(k % 2 == 0, F.array(F.concat(F.lit("c"), k.cast("string")))).otherwise(F.array().cast("array<string>"))).alias("j"))


@query("", "SELECT o_orderkey, 'p1' || chr(10) || chr(10) || 'p' || o_orderkey AS t FROM orders")
def markdown_pages_text(g):
    pages = F.array(F.lit("p1 "), F.lit("  "), F.concat(F.lit(" p"), F.col("o_orderkey").cast("string")))
    return g.raw("orders").select("o_orderkey", T.join_texts(pages, "\n\n").alias("t"))


@query("answers", """SELECT result_id, question_id, len(list_filter(regexp_split_to_array(answer_text, '\\s+'),
lambda w: w <> '')) < 3 OR coalesce(ocr_confidence < 0.7, false) AS fallback FROM answers""")
def needs_fallback(g):
    return g.answers().select("result_id", "question_id", S.needs_fallback(T.word_count(F.col("answer_text")), F.col("ocr_confidence")).alias("fallback"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE (o_orderkey % 9)::INT END AS i FROM orders")
def int_or_default(g):
    k = F.col("o_orderkey")
    return g.raw("orders").select("o_orderkey", S.int_or(F.when(k % 3 == 0, "x").otherwise((k % 9).cast("string")), F.lit(5)).alias("i"))


@query("", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE (o_orderkey % 90) / 8.0 END::DOUBLE AS f FROM orders")
def float_or_default(g):
    k = F.col("o_orderkey")
    return g.raw("orders").select("o_orderkey", S.float_or(F.when(k % 3 == 0, "x").otherwise((k % 90 / 8).cast("string")), F.lit(0.5)).alias("f"))


@query("", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'expected_answer' WHEN 1 THEN 'question_text' WHEN 2 THEN 'valor_padrao'
WHEN 3 THEN 'instrucoes' WHEN 4 THEN 'critérios de correcao' ELSE 'outro' END AS k FROM orders""")
def normalize_field_key(g):
    k = F.col("o_orderkey") % 6
    label = F.when(k == 0, "Padrão de Resposta").when(k == 1, " Enunciado ").when(k == 2, "Valor padrão (pontos)").when(k == 3,
        "Instruções gerais").when(k == 4, "Critérios de correção").otherwise("Outro")
    return g.raw("orders").select("o_orderkey", T.field_key(label).alias("k"))


@query("", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['m1', 'm2', 'm3'] WHEN o_orderkey % 3 = 1 THEN ['m2']
ELSE ['padrao'] END AS models FROM orders""")
def model_candidates(g):
    k = F.col("o_orderkey") % 3
    models = T.candidates(F.when(k == 0, "m1").when(k == 1, " m2"), F.when(k == 0, "m2, m1 ,, m3").when(k == 1, "texto").otherwise(" ,"), "padrao", ["texto"])
    return g.raw("orders").select("o_orderkey", models.alias("models"))


@query("answers", """WITH n AS (SELECT result_id, question_id,
list_filter(string_split(trim(regexp_replace(regexp_replace(lower(answer_text), '[^a-z0-9áàâãéèêíïóôõöúçñ\\s]', ' ', 'g'), '\\s+', ' ',
'g')), ' '), lambda w: w <> '') AS a, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(question_text),
'[^a-z0-9áàâãéèêíïóôõöúçñ\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS b FROM answers)
SELECT result_id, question_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(1, len(list_distinct(a))), 9) AS overlap FROM n""")
def token_overlap(g):
    tokens = lambda c: F.array_distinct(T.words(T.normalize_text(c)))
    rows = g.answers({"own": tokens, "n_own": lambda c: F.size(tokens(c))}, {"asked": tokens})
    return rows.select("result_id", "question_id", F.round(T.token_overlap(F.col("own"), F.col("asked"), F.col("n_own")), 9).alias("overlap"))


@query("answers", """SELECT result_id, question_id, CASE WHEN trim(answer_text) <> '' AND NOT starts_with(lower(trim(answer_text)),
'erro no processamento:') THEN md5(trim(answer_text)) END AS shown FROM answers""")
def display_justification(g):
    return g.answers().select("result_id", "question_id", F.md5(T.display_justification(F.col("answer_text")).cast("binary")).alias("shown"))

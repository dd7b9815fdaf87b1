"""Published tables, request lines, boxes on grids, widths of fonts, and operators as table functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scoreweave.functions import tables as Q
from scoreweave.functions import text as T
from scoreweave.operators import maintain as M
from scoreweave.operators import sheets as H
from scoreweave.sources import files as L
from scoreweave.sources import requests as N
from scoreweave.sources.publish import Published, Sheet
from scoreweave.sources.work import work_folder

HARD = ["", None, 'a "quoted", text', "two\nlines", "semi;colon\\ and tab\t", "ação"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_sheets_come_back_as_they_were(spark, kind):
    rows = spark.createDataFrame([(i % 3, i, t, None if i == 2 else i / 4) for i, t in enumerate(HARD)], "batch_id long, result_id long, said string, score double")
    to = Published(spark, work_folder(spark, "published"))
    assert to.write(final=Sheet(rows, kind, F.col("batch_id"), ("batch_id", "result_id"))) == {"final": 6}
    back = to.read("final")
    assert back.columns == [*rows.columns, "part"]
    want = rows.withColumn("said", F.nullif("said", F.lit(""))) if kind == "csv" else rows  # a cell of CSV has no null besides the empty text
    assert sorted(back.drop("part").collect(), key=lambda r: r["result_id"]) == sorted(want.collect(), key=lambda r: r["result_id"])
    assert "PartitionFilters: [isnotnull(part" in back.where("part = 1")._jdf.queryExecution().executedPlan().toString()


def test_a_version_replaces_the_one_before_as_a_whole(spark):
    to = Published(spark, work_folder(spark, "published"))
    with pytest.raises(LookupError):
        to.read("a")
    one = spark.createDataFrame([("x",), ("y",)], "line string")
    to.write(a=Sheet(one, "text"), b=Sheet(one, "text"))
    to.write(a=Sheet(one.where("line = 'x'"), "text"))
    assert [r[0] for r in to.read("a").collect()] == ["x"]
    with pytest.raises(LookupError):
        to.read("b")
    assert to.write(a=Sheet(one.where("line = 'z'"), "text")) == {"a": 0} and to.read("a").count() == 0
    assert len(to.sweep(0, keep=1)) == 2 and to.read("a").count() == 0


def test_a_failed_writing_leaves_nothing(spark):
    to = Published(spark, work_folder(spark, "published"))
    good = spark.range(5).select("id")
    to.write(a=Sheet(good), b=Sheet(good))
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    before = to._names(f"{to.path}/versions")
    with pytest.raises(Exception, match="lost"):
        to.write(a=Sheet(good.limit(1)), b=Sheet(bad))
    assert to._names(f"{to.path}/versions").keys() == before.keys() and to.read("a").count() == 5


def test_a_writing_whose_driver_is_lost_is_not_seen(spark):
    to = Published(spark, work_folder(spark, "published"))
    to.write(a=Sheet(spark.range(5)))
    spark.range(9).write.parquet(f"{to._folder('killed')}/a")
    assert to.read("a").count() == 5 and to.sweep(3600) == []
    assert to.sweep(0) == ["killed"] and to.read("a").count() == 5


def test_gradebook_sheets(spark):
    rows = spark.createDataFrame([(b, 10 * b + r, "Motivo; com \"aspas\"") for b in range(5) for r in range(3)], "batch_id long, result_id long, reason string")
    to = Published(spark, work_folder(spark, "published"))
    assert L.publish_gradebook(to, rows, rows, rows.where("batch_id = 4"), batches_per_part=2) == {"final": 15, "detail": 15, "review": 3}
    assert sorted({r["part"] for r in to.read("final").select("part").collect()}) == [0, 1, 2]
    assert sorted(to.read("review").drop("part").collect()) == sorted(rows.where("batch_id = 4").collect())


ANSWERS = [(1, 7, "O que é?", "Um músculo", 1.0, "resposta {expected_answer}"), (2, 8, None, 'com "aspas"\n', 2.5, ""), (3, 9, "x", "y", 0.25, None)]
KIND = "result_id long, question_number int, question_text string, expected_answer string, max_score double, ocr_text string"


def test_requests_for_one_question(spark):
    rows = spark.createDataFrame(ANSWERS, KIND)
    made = {r[0]: json.loads(r[1]) for r in N.question_requests(rows, "Q{question_number} ({max_score}) {question_text}|{expected_answer}|{ocr_text} {other}", 'S "1"', "m/x", ["result_id"]).collect()}
    assert made[1]["messages"] == [{"role": "system", "content": 'S "1"'}, {"role": "user", "content": "Q7 (1.0) O que é?|Um músculo|resposta {expected_answer} {other}"}]
    assert made[2]["messages"][1]["content"] == 'Q8 (2.5) |com "aspas"\n|(vazio) {other}' and made[3]["messages"][1]["content"].endswith("(vazio) {other}")
    assert {k: v for k, v in made[1].items() if k != "messages"} == {"model": "m/x", "temperature": 0.1, "max_tokens": 1536}


def test_requests_with_images(spark):
    rows = spark.createDataFrame([(*a, bytes(range(200)) if a[0] != 3 else None) for a in ANSWERS], KIND + ", png binary")
    made = {r[0]: json.loads(r[1]) for r in N.image_requests(rows, "{ocr_text}", "s", "m", ["result_id"]).collect()}
    assert sorted(made) == [1, 2]
    text, image = made[2]["messages"][1]["content"]
    assert text == {"type": "text", "text": "(sem transcrição confiável)"} and image["type"] == "image_url"
    import base64

    assert image["image_url"] == {"url": "data:image/png;base64," + base64.b64encode(bytes(range(200))).decode()}


def test_requests_for_pages_and_contexts(spark):
    questions = spark.createDataFrame([(1, 2, "dois", "b", 1.0), (1, 1, "um", "a", 0.5)], "exam_id long, question_number int, question_text string, expected_answer string, max_score double")
    pages = spark.createDataFrame([(10, 1, "lido"), (11, 1, " \n\t"), (12, 1, None), (13, 2, "sem prova")], "page_id long, exam_id long, ocr_text string")
    made = N.exam_requests(pages, questions, "{questions_text}#{ocr_text}", "s", "m", ["page_id"]).collect()
    assert [r[0] for r in made] == [10]
    assert json.loads(made[0][1])["messages"][1]["content"] == "**Questão 1** (vale 0.5 pts)\nEnunciado: um\nGabarito: a\n\n**Questão 2** (vale 1.0 pts)\nEnunciado: dois\nGabarito: b\n#lido"
    known = spark.createDataFrame([(1, "Ana", None), (2, None, None)], "page_id long, student_name string, exam string")
    prompts = {r[0]: r[1] for r in N.context_prompts(known, " Leia. ", ["student_name", "exam"], ["page_id"]).collect()}
    assert prompts[2] == "Leia.\n\n" + N.CONTEXT_END
    assert prompts[1] == "Leia.\n\n" + N.CONTEXT_HEAD + '\n{"student_name":"Ana"}\n\n' + N.CONTEXT_END


def _brute_pairs(rows, most):
    def ratio(a, b):
        side = lambda p, s: max(0, min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p]))
        return side(2, 4) * side(3, 5) / min(a[4] * a[5], b[4] * b[5])

    ok = [r for r in rows if r[4] > 0 and r[5] > 0]
    return sorted((a[0], a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and ratio(a, b) > most)


@pytest.mark.parametrize("most", [0.0, 0.65])
def test_overlaps_on_a_grid_are_all_overlaps(spark, most):
    rng = random.Random(5)
    sizes = [1, 2, 3, 4, 7, 8, 16, 33, 64, 400, 1000, 0]
    rows = [(p, 1000 * p + i, rng.randint(-50, 900), rng.randint(-50, 900), rng.choice(sizes), rng.choice(sizes)) for p in range(3) for i in range(150)]
    rows += [(1, 5000 + i, 10, 10, 64, 64) for i in range(4)]
    got = H.overlapping_pairs(spark.createDataFrame(rows, "page long, box_id long, x int, y int, w int, h int"), ["page"], most).collect()
    assert sorted(map(tuple, got)) == _brute_pairs(rows, most)


def test_a_crowded_page_forms_few_pairs(spark):
    n = 90
    rows = spark.range(n * n).select((F.col("id") % 1).alias("page"), F.col("id").alias("box_id"), (F.col("id") % n * 16).cast("int").alias("x"),
        F.floor(F.col("id") / n).cast("int").alias("y")).withColumn("y", F.col("y") * 16).withColumns({"w": F.lit(12), "h": F.lit(12)})
    got = H.overlapping_pairs(rows, ["page"])
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_cx" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert H.overlapping_pairs(rows, ["page"], -1.0).count() <= 16 * n * n  # with any ratio: what shares the cell of its corner, of 32,800,950 pairs


def _width(text):
    return sum(next((w for w, chars in T.HELVETICA.items() if ch in chars), T.OTHER_WIDTH) for ch in text)


def _wrap(text, most, size):
    lines, cur = [], ""
    for word in text.split():
        candidate = f"{cur} {word}".strip()
        if cur and _width(candidate) * size / 1000 > most:
            lines.append(cur)
            cur = word
        else:
            cur = candidate
    return lines + [cur] if cur else lines


def test_widths(spark):
    every = "".join(T.HELVETICA.values())
    assert len(every) == len(set(every)) and set(map(chr, range(32, 127))) <= set(every)
    assert _width("Helvetica") == 722 + 556 + 222 + 500 + 556 + 278 + 222 + 500 + 556 and _width("0") == 556 and _width("W") == 944
    texts = ["", None, "iiii WWWW", "Explique a estrutura anatômica indicada e sua relação funcional. " * 9, "x" * 400, "a " * 300, "ÁÉÍ {|} 日本 \n\n fim"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("i", "t", T.text_width(F.col("t")).alias("n"), T.wrap_by_width(F.col("t"), 481.8, 8).alias("lines")).collect():
        assert r["n"] == (None if r["t"] is None else _width(r["t"]))
        assert r["lines"] == _wrap(r["t"] or "", 481.8, 8)


def test_sheets_by_widths(spark):
    said = "Explique a estrutura anatomica indicada e sua relacao funcional."
    rows = spark.createDataFrame([(1, i, said) for i in range(1, 9)], "exam_id long, question_number int, question_text string")
    placed = H.paginate(rows, H.TEXT_W).collect()
    assert {r["pages"] for r in placed} == {2} and {r["page"] for r in placed} == {1, 2}
    second = min((r for r in placed if r["page"] == 2), key=lambda r: r["question_number"])
    bottom_of_code = H.PAGE_H - H.MARGIN - H.TOP_INSET - H.QR_SIZE
    assert second["y_bottom_pt"] + second["height_pt"] < bottom_of_code - 5 * H.MM
    wide = rows.withColumn("question_text", F.repeat(F.lit("WWWWWWWW "), 12))
    tall = {r["question_number"]: r["y_bottom_pt"] for r in H.paginate(wide, H.TEXT_W).collect()}
    flat = {r["question_number"]: r["y_bottom_pt"] for r in H.paginate(wide).collect()}
    assert tall[1] == pytest.approx(flat[1]) or tall[1] < flat[1]


def test_operators_from_sql(spark):
    a, b = "550e8400-e29b-41d4-a716-446655440000", "650e8400-e29b-41d4-a716-446655440000"
    pages = spark.createDataFrame([(1, "E", f"MQPC|E|{a}|1|2", None, b), (2, "E", None, b, None), (3, "F", f"MQPC|E|{a}|1|2", None, None)],
        "page_id long, exam_id string, qr_payload string, header_student string, manifest_student string")
    texts = spark.createDataFrame([(5, "Questão 1\nEnunciado: um\nGabarito: a\nQuestão 2\nGabarito: b"), (6, "Q1\nPergunta: seis")], "exam_id long, text string")
    students = spark.createDataFrame([(1, "r1", "Ana", "Med"), (2, "r9", "Rui", "Med")], "class_id long, registration_number string, student_name string, curso string")
    roster = spark.createDataFrame([(1, "r1", "Ana B", "Med", "T1", 1), (1, "r2", "Bia", "Med", None, 2)],
        "class_id long, registration_number string, student_name string, curso string, turma string, line int")
    classes = spark.createDataFrame([(1, "velha"), (2, "dois")], "class_id long, class_name string")
    given = {"pages": pages, "exam_texts": texts, "students": students, "roster": roster, "classes": classes}
    names = Q.register_operators(spark, given)
    assert names == ["sw_pick_identity", "sw_parse_exam_lines", "sw_roster_upsert", "sw_roster_classes", "sw_roster_report"]
    rows = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert rows("SELECT page_id, student_id, identity_source FROM sw_pick_identity() ORDER BY 1") == [(1, a, "qr"), (2, b, "header_ocr"), (3, None, "anonymous")]
    assert rows("SELECT page_id FROM sw_pick_identity(exam_id => 'F')") == [(3,)]
    assert rows("SELECT question_number, kept FROM sw_parse_exam_lines(5) ORDER BY 1") == [(1, True), (2, False)]
    assert rows("SELECT count(*) FROM sw_parse_exam_lines(NULL)") == [(3,)]
    upserted = M.roster_upsert(students, roster)
    columns = ", ".join(upserted.columns)
    assert sorted(map(str, rows(f"SELECT {columns} FROM sw_roster_upsert()"))) == sorted(str(tuple(r)) for r in upserted.select(*upserted.columns).collect())
    assert rows("SELECT registration_number, action FROM sw_roster_upsert(class_id => 2)") == [("r9", "keep")]
    assert rows("SELECT class_name, action FROM sw_roster_classes(1)") == [("T1", "rename")]
    assert rows("SELECT r.message FROM sw_roster_report() r JOIN sw_roster_classes() c USING (class_id)") == [("1 novos, 1 atualizados.",)]
    with pytest.raises(ValueError, match="no such columns"):
        Q.register_table_function(spark, "sw_x", pages, ["nothing"])


def test_sheet_plan_places_students_once(spark):
    """Exams of one, of several and of repeated classes, repeated students; the plan's own rows are neither sorted nor shuffled."""
    from scoreweave.operators import sheets as H

    exams = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (4, 2), (5, 2), (5, 2), (6, 9), (7, None), (8, 1)], "exam_id long, class_id long")
    people = [(10, 1, "b"), (11, 1, "a"), (12, 1, None), (12, 1, None), (13, 2, "a"), (11, 2, "a"), (14, 2, "c")]
    students = spark.createDataFrame(people, "student_id long, class_id long, registration_number string")
    layout = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (3, 1), (4, 2), (5, 3), (6, 2), (7, 1)], "exam_id long, pages int")
    plan = H.sheet_plan(exams, students, layout)
    most = {1: 3, 2: 2, 3: 1, 4: 2, 5: 3, 6: 2, 7: 1}
    rows = sorted((e, r is not None, r or "", s, p) for e, c in [tuple(x) for x in exams.collect()] for s, k, r in people if c == k for p in range(1, most.get(e, 0) + 1))
    at, want = {}, []
    for e, some, r, s, p in rows:
        want.append((e, s, r if some else None, p, most[e], at.setdefault(e, 0)))
        at[e] += 1
    assert sorted(map(str, map(tuple, plan.collect()))) == sorted(map(str, want)) and len(want) == 55
    assert "windowspecdefinition(exam_id" not in plan._jdf.queryExecution().toString()


def test_finished_after_dealing(spark, tmp_path):
    """What finish adds is published in order, in no shuffle; JSON lines are compressed."""
    names = spark.createDataFrame([(i, "texto " * 400 + str(i)) for i in range(5)], "k long, name string")
    rows = spark.range(2000).select("id", (F.col("id") % 5).alias("k"))
    to = Published(spark, f"file://{tmp_path}/out")
    assert to.write(all=Sheet(rows, "json", F.floor(F.col("id") / 1000), ("id",), lambda r: r.join(F.broadcast(names), "k"))) == {"all": 2000}
    back = to.read("all")
    assert sorted(back.columns) == ["id", "k", "name", "part"] and back.where("name = 'x'").count() == 0
    assert {(r["id"], r["part"], r["name"][-1]) for r in back.collect()} == {(i, i // 1000, str(i % 5)) for i in range(2000)}
    files = [p for p in tmp_path.rglob("*.json.gz")]
    assert files and sum(p.stat().st_size for p in files) < 200_000 and not list(tmp_path.rglob("part-*.json"))

"""Files as sources: listings without contents, streams of uploads, whole texts; provider errors."""

import json

from pyspark.sql import functions as F

from scoreweave.operators import responses as P
from scoreweave.sources import files as L
from scoreweave.streaming import grading as X
from scoreweave.streaming import uploads as U

PENDING = ("PENDING", None)


def _put(folder, **sizes):
    folder.mkdir(exist_ok=True)
    for name, size in sizes.items():
        name = name.replace("__", ".")
        (folder / name).write_bytes(b"x" * size)


def _said(rows):
    return sorted((r["file_name"], r["status"], r["reject_reason"]) for r in rows.collect())


def test_a_listing_reads_no_content(spark, tmp_path):
    _put(tmp_path / "a", eins__pdf=5, zwei__PDF=0)
    _put(tmp_path / "b", drei__docx=3, vier__pdf=3 << 20)
    files = L.list_files(spark, f"file://{tmp_path}")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan.partition("ReadSchema")[2]
    rows = L.register_batches(files, most_mb=2)
    assert _said(rows) == [("drei.docx", None, "extension"), ("eins.pdf", *PENDING), ("vier.pdf", None, "too_large")]  # files of no bytes are not listed
    listed = spark.createDataFrame([("file:/in/zwei.PDF", 0, None)], "path string, length long, modificationTime timestamp")
    assert _said(L.register_batches(listed)) == [("zwei.PDF", None, "empty")]
    urls = [r["file_url"] for r in rows.where("status is not null").collect()]
    assert len(urls) == 1 and urls[0].startswith("local:batches/") and urls[0].endswith(".pdf")


def test_each_upload_is_registered_once(spark, tmp_path):
    folder, (path, checkpoint) = tmp_path / "in", X.new_folders(spark, "registered")
    assert U.registered_uploads(spark, path).count() == 0
    _put(folder, eins__pdf=5, zwei__doc=2)
    run = lambda: U.register_uploads(spark, f"file://{folder}", path, checkpoint, files_per_trigger=1)
    run()
    run()  # nothing new
    (folder / "eins.pdf").unlink()  # a registered file may go
    _put(folder / "unter", drei__txt=1, vier__pdf=9)
    run()
    want = [("drei.txt", None, "extension"), ("eins.pdf", *PENDING), ("vier.pdf", *PENDING), ("zwei.doc", None, "extension")]
    assert _said(U.registered_uploads(spark, path)) == want


def test_an_epoch_of_uploads_that_comes_again_is_replaced(spark, tmp_path):
    folder, (path, checkpoint) = tmp_path / "in", X.new_folders(spark, "registered")
    _put(folder, eins__pdf=5, zwei__pdf=6)
    for again in "ab":  # another checkpoint: the same epoch number once more
        U.register_uploads(spark, f"file://{folder}", path, checkpoint + again)
    assert _said(U.registered_uploads(spark, path)) == [("eins.pdf", *PENDING), ("zwei.pdf", *PENDING)]


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Questão 1\n\n  Enunciado: x \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("")
    texts = L.read_texts(spark, f"file://{tmp_path}").withColumn("file", F.element_at(F.split("file", "/"), -1))
    lines = L.text_lines(texts, "file", "text").collect()
    assert sorted(tuple(r) for r in lines) == [("a.txt", 0, "Questão 1"), ("a.txt", 2, "Enunciado: x")]


def test_error_messages(spark):
    cases = [
        ({"error": {"message": "zu viel", "code": 429}}, "zu viel"), ({"error": {"message": None, "code": 429}}, "429"),
        ({"error": {"message": "", "code": "x"}}, "x"), ({"error": {"message": 0, "code": 0}}, "sem detalhe"), ({"error": {}}, "sem detalhe"),
        ({"error": {"message": "0"}}, "0"), ({"error": "kurz"}, "kurz"), ({"error": ""}, ""), ({"error": 7}, "7"), ({"error": False}, "false"),
        ({"error": None, "message": "m"}, "m"), ({"message": "", "detail": "d"}, "d"), ({"message": "m", "detail": "d"}, "m"), ({"detail": ""}, ""),
        ({"detail": None}, '{"detail": null}'), ({"error": ["a"]}, '["a"]'), ([1, 2], "[1, 2]"), ({"a": "x" * 400}, ('{"a": "' + "x" * 400)[:300]),
    ]
    texts = [("  kaputt { ", "kaputt {"), ("", "sem detalhe"), (None, "sem detalhe"), ("   ", ""), ("y" * 500, "y" * 300)]
    rows = [(json.dumps(raw), want) for raw, want in cases] + texts
    got = spark.createDataFrame(rows, "raw string, want string").select("raw", "want", P.error_message(F.col("raw")).alias("got")).collect()
    assert [(r["raw"], r["got"]) for r in got] == [(r["raw"], r["want"]) for r in got]


def test_pages_of_progress_are_exact(spark, tmp_path):
    folder, (path, checkpoint) = f"file://{tmp_path}/in", X.new_folders(spark, "progress")
    batches = spark.createDataFrame([(1, 3), (2, 0)], "batch_id long, total_pages long")
    assert X.latest_progress(spark, path, batches).count() == 0

    def arrive(*rows):
        for row in rows:  # a file each, so that a page comes in several epochs
            spark.createDataFrame([row], "batch_id long, result_id long, requires_manual_review boolean").coalesce(1).write.mode("append").parquet(folder)
        X.progress(X.open_stream(spark, folder, files_per_trigger=1), path, checkpoint)

    told = lambda: {tuple(r) for r in X.latest_progress(spark, path, batches).collect()}
    arrive((1, 10, False), (1, 10, False), (2, 20, True))
    assert told() == {(1, 1, 2, 0, "DONE", 33), (2, 1, 1, 1, "REVIEW_PENDING", None)}
    arrive((1, 11, True), (1, 10, None), (1, None, False), (3, 30, False))
    assert told() == {(1, 2, 5, 1, "REVIEW_PENDING", 66), (2, 1, 1, 1, "REVIEW_PENDING", None), (3, 1, 1, 0, "DONE", None)}
    assert "percent" not in X.latest_progress(spark, path).columns


def test_reject_reasons_in_order(spark):
    cases = [("a.pdf", 1, None, None), ("A.PDF", 1, "application/pdf", None), ("a.pdf", 1, "", None), ("a.doc", 0, "text/html", "extension"),
        (None, 1, None, "extension"), ("a.pdf", 0, "text/html", "content_type"), ("a.pdf", 0, "application/x-pdf", "empty"), ("a.pdf", (40 << 20) + 1, None, "too_large"),
        ("a.pdf", 40 << 20, None, None)]
    rows = spark.createDataFrame(cases, "name string, size long, type string, want string")
    got = rows.select("want", L.reject_reason(F.col("name"), F.col("size"), content_type=F.col("type")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_highest_score(spark):
    cases = [('{"max_score": 2}', 3.0, '{"max_score": 4}', 2.0), ('{"max_score": 0}', 3.0, None, 3.0), ("{}", 0.0, '{"max_score": 4, "valor": 5}', 4.0),
        (None, None, '{"max_score": "", "valor": "5.5"}', 5.5), (None, None, '{"valor": "5,5"}', 1.0), ("{}", None, "{}", 1.0), ("{}", None, None, 1.0), ('{"max_score": "viel"}', 3.0, None, 1.0),
        ('{"max_score": false}', None, '{"valor": 2.5}', 2.5)]
    rows = spark.createDataFrame(cases, "response string, question double, rubric string, want double")
    of = lambda c: F.try_parse_json(F.col(c))
    got = rows.select("want", P.highest_score(of("response"), F.col("question"), of("rubric")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_first_answers_and_what_they_replace(spark):
    from scoreweave.operators.ranking import first_answers

    rows = spark.createDataFrame([(1, 1, "b", 2), (1, 1, "a", 1), (1, 1, "c", 3), (1, 0, "x", 4), (1, -2, "y", 5), (1, None, "z", 6), (2, 1, None, 1),
        (None, 1, "q", 1)], "page long, number int, text string, at int")
    got = {(r["page"], r["number"]): (r["text"], r["kept"], r["n_warnings"], r["warning"]) for r in first_answers(rows, "page", "number", ["at"]).collect()}
    assert got == {
        (1, 1): ("a", True, 2, "Questão duplicada na leitura visual (Q1, página 1); mantendo primeira ocorrência."),
        (1, None): (None, False, 3, "Questão sem número válido na página 1."), (2, 1): (None, True, 0, None), (None, 1): ("q", True, 0, None),
    }
    assert first_answers(rows.limit(0), "page", "number", ["at"]).count() == 0


def test_what_cannot_be_repaired_is_replaced(spark):
    cases = [('{"nota": 1}', None, None), ("[1]", "json_root_not_object", "[1]"), ("x" * 600, "invalid_json", "x" * 500), (None, "invalid_json", ""), ("{a", "invalid_json", "{a")]
    rows = spark.createDataFrame(cases, "raw string, error string, preview string")
    for r in P.repair_or_replace(rows, "raw").collect():
        read = json.loads(r["json"])
        assert (read.get("erro_parse"), read.get("raw_response_preview")) == (r["error"], r["preview"]), r
        if r["error"]:
            assert r["attempt"] is None and read["nota"] == 0 and read["revisao_necessaria"] is True and read["criterios_atendidos"] == []


def test_rubrics_of_questions_and_of_whole_documents(spark):
    rubrics = spark.createDataFrame([(1, '[{"number":1}]'), (2, '{"texto":"tudo"}'), (3, "{}"), (4, "kein JSON"), (5, None)], "exam_id long, json string")
    answers = spark.createDataFrame([(e, n) for e in range(1, 7) for n in (1, 2)], "exam_id long, question_number int")
    got = {(r["exam_id"], r["question_number"]): r["rubric"] for r in P.with_rubrics(answers, rubrics).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {(1, 1): '{"number":1}', (2, 1): '{"texto":"tudo"}', (2, 2): '{"texto":"tudo"}'}

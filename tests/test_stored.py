"""Stored tables: only touched partitions are written again; and loads of whole rosters."""

import pytest
from pyspark.sql import functions as F

from scoreweave.operators import maintain as M
from scoreweave.sources.stored import GradingStore
from scoreweave.sources.work import work_folder


@pytest.fixture
def store(spark):
    batches = spark.createDataFrame([(b, b % 3, "DONE" if b != 7 else "PROCESSING", 2) for b in range(12)], "batch_id long, exam_id long, status string, total_pages long")
    results = spark.createDataFrame([(10 * b + p, b, None if p else b) for b in range(12) for p in range(2)], "result_id long, batch_id long, student_id long")
    scores = spark.createDataFrame([(10 * b + p, q, 0.5) for b in range(12) for p in range(2) for q in range(3)], "result_id long, question_id long, ai_score double")
    return GradingStore(spark, work_folder(spark, "store"), 4).create(batches, results, scores)


def files(table):
    return {p: names for p, (_, names) in table._files().items()}


def ids(table, key):
    return sorted(r[0] for r in table.read().select(key).collect())


def test_clearing_writes_touched_partitions_only(spark, store):
    before = files(store.results), files(store.scores)
    gone = spark.createDataFrame([(1,), (1,), (99,), (None,)], "batch_id long")
    assert store.clear_batches(gone) == {"results": 2, "scores": 6}
    for table, old in zip((store.results, store.scores), before, strict=True):
        new = files(table)
        assert new[1] == old[1] and new[2] == old[2] and not new[0] & old[0]
        assert 1 not in ids(table, "batch_id") and len(ids(table, "batch_id")) == (22 if table is store.results else 66)
    assert store.clear_batches(gone) == {"results": 0, "scores": 0}


def test_a_partition_without_rows_goes(spark, store):
    gone = spark.createDataFrame([(b,) for b in range(4, 8)], "batch_id long")
    assert store.clear_batches(gone) == {"results": 8, "scores": 24}
    assert sorted(files(store.results)) == [0, 2] and 5 not in ids(store.scores, "batch_id")
    assert store.clear_batches(gone) == {"results": 0, "scores": 0}
    assert store.clear_batches(spark.createDataFrame([], "batch_id long")) == {"results": 0, "scores": 0}


def test_exams_go_with_their_batches(spark, store):
    assert store.delete_exams(spark.createDataFrame([(2,), (None,)], "exam_id long")) == {"batches": 4, "results": 8, "scores": 24}
    assert ids(store.batches, "batch_id") == [b for b in range(12) if b % 3 != 2]
    assert sorted(set(ids(store.scores, "batch_id"))) == [b for b in range(12) if b % 3 != 2]


def test_unlinking_touches_partitions_with_such_results(spark, store):
    before = files(store.results)
    assert store.unlink_students(spark.createDataFrame([(0,), (9,), (77,), (None,)], "student_id long")) == 2
    after = files(store.results)
    assert after[1] == before[1] and after[0] != before[0] and after[2] != before[2]
    assert sorted(r[0] for r in store.results.read().where("student_id is not null").select("student_id").collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    assert store.results.read().count() == 24
    assert store.unlink_students(spark.createDataFrame([(77,)], "student_id long")) == 0


def test_reprocessing_resets_and_clears(spark, store):
    asked = spark.createDataFrame([(1, 1), (7, 1), (5, 0), (3, 0), (3, 0), (50, 1)], "batch_id long, exam_id long")
    got = {r["batch_id"]: r["outcome"] for r in store.reprocess(asked).collect()}
    assert got == {1: "reset", 7: "refused", 5: "refused", 3: "reset"}
    state = {r["batch_id"]: (r["status"], r["total_pages"]) for r in store.batches.read().collect()}
    assert state[1] == state[3] == ("PENDING", 0) and state[5] == ("DONE", 2) and state[7] == ("PROCESSING", 2) and len(state) == 12
    assert {1, 3} & set(ids(store.results, "batch_id")) == set() and {5, 7} < set(ids(store.scores, "batch_id"))


def test_rosters_load_whole_or_not_at_all(spark):
    students = spark.createDataFrame([(1, "a", "Ana", "x"), (1, "b", "Bia", None), (2, "a", "Caio", "y"), (4, "q", "Dora", "z")],
        "class_id long, registration_number string, student_name string, curso string")
    classes = spark.createDataFrame([(1, "um"), (2, "dois"), (4, "quatro")], "class_id long, class_name string")
    rows = [(1, "a", "Ana", "x", " ", 1), (1, "b", "Bia", "c", None, 2), (1, "n", "Novo", "x", " T1 ", 3), (1, "n", "Novo 2", "x", "T2", 4),
        (2, "a", "Caio", "y", "Turma dois", 1), (3, "z", "Zeca", "", "", 1), (None, "a", "Sem turma", "", "X", 1)]
    rows += [(4, f"r{i}", "Muitos", "", "Cheia", i) for i in range(6)]
    roster = spark.createDataFrame(rows, "class_id long, registration_number string, student_name string, curso string, turma string, line int")
    load = M.load_rosters(students, classes, roster, 5)
    report = {r["class_id"]: (r["n_rows"], r["inserted"], r["updated"], r["outcome"], r["message"]) for r in load.report.collect()}
    assert report == {1: (4, 1, 1, "loaded", "1 novos, 1 atualizados."), 2: (1, 0, 0, "nothing_changed", "Nenhuma linha de aluno válida encontrada."),
        3: (1, 1, 0, "loaded", "1 novos, 0 atualizados."), 4: (6, 0, 0, "too_many_rows", "Máximo 5 alunos.")}
    named = {r["class_id"]: (r["class_name"], r["action"]) for r in load.classes.collect()}
    assert named == {1: ("T1", "rename"), 2: ("Turma dois", "rename"), 3: ("Turma 3", "create"), 4: ("quatro", "keep")}
    kept = {(r["class_id"], r["registration_number"]): (r["student_name"], r["curso"], r["action"]) for r in load.students.collect()}
    assert kept == {(1, "a"): ("Ana", "x", "keep"), (1, "b"): ("Bia", "c", "update"), (1, "n"): ("Novo 2", "x", "insert"), (2, "a"): ("Caio", "y", "keep"),
        (3, "z"): ("Zeca", "", "insert"), (4, "q"): ("Dora", "z", "keep")}
    none = M.load_rosters(students, classes, roster.limit(0))
    assert none.report.count() == 0 and none.classes.where("action <> 'keep'").count() == 0 and none.students.where(F.col("action") != "keep").count() == 0

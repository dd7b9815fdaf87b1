"""Streams whose rows lie in several micro-batches, and that start again on their checkpoint."""

from datetime import datetime, timedelta

import pytest

from scoreweave.streaming import grading as X


ANSWERS = "batch_id long, result_id long, question_id long, score double, total_pages int"


def _sent(spark, folder, rows, files=1):
    for k in range(files):
        spark.createDataFrame(rows[k::files], ANSWERS).coalesce(1).write.mode("append").parquet(folder)


def _graded(spark, path):
    return sorted(map(tuple, X.latest_grades(spark, path).select("batch_id", "result_id", "question_id", "score", "complete").collect()), key=str)


def test_a_batch_split_over_triggers_is_graded_once_it_is_whole(spark, tmp_path):
    rows = [(b, 10 * b + page, q, 0.25, 5) for q in range(2) for b in range(3) for page in range(5)]
    folder, (path, checkpoint) = f"file://{tmp_path}/in", X.new_folders(spark, "graded")
    _sent(spark, folder, rows, 3)  # a page's two answers are in one file, a batch's pages in several
    asked = []
    X.grade_batches(X.open_stream(spark, folder, 1, "arrived_at"), lambda r: asked.append(1) or r, path, checkpoint)
    assert _graded(spark, path) == sorted(((b, p, q, s, True) for b, p, q, s, _ in rows), key=str) and len(asked) >= 3
    generations = X.generations(spark, path).collect()
    assert {r["batch_id"]: (r["n_rows"], r["complete"]) for r in generations} == {b: (10, True) for b in range(3)}
    files = [f for f in spark.read.parquet(f"{path}/rows").inputFiles()]
    assert len(files) <= 2 * len(asked)  # not one for each batch and task


def test_grading_again_replaces_the_whole_batch(spark, tmp_path):
    folder, (path, checkpoint) = f"file://{tmp_path}/in", X.new_folders(spark, "graded")
    grade = lambda: X.grade_batches(X.open_stream(spark, folder, 1, "arrived_at"), lambda r: r, path, checkpoint)
    first = [(1, 1, 1, 0.5, 2), (1, 1, 2, 0.5, 2), (1, 2, 1, 0.75, 2), (2, 3, 1, 0.25, 1)]
    _sent(spark, folder, first)
    grade()
    kept = [(2, 3, 1, 0.25, True)]
    assert _graded(spark, path) == sorted([r[:4] + (True,) for r in first])
    _sent(spark, folder, [(1, 1, 1, 1.0, 1)])  # again, with one page and fewer answers
    grade()
    assert _graded(spark, path) == [(1, 1, 1, 1.0, True), *kept]
    _sent(spark, folder, [(1, 5, 1, 0.0, 2)])  # half of a third round: the second one stands until it is whole
    grade()
    assert _graded(spark, path) == [(1, 1, 1, 1.0, True), *kept]
    last = X.compact_grades(spark, path)
    assert last is not None and _graded(spark, path) == [(1, 1, 1, 1.0, True), *kept] and X.compact_grades(spark, path) == last
    _sent(spark, folder, [(1, 6, 1, 0.25, 2)])
    grade()
    third = [(1, 5, 1, 0.0, True), (1, 6, 1, 0.25, True), *kept]
    assert _graded(spark, path) == third
    assert X.compact_grades(spark, path, drop_before=True) > last and _graded(spark, path) == third
    assert not X._folders(spark, f"{path}/rows", "epoch")


def test_an_epoch_that_comes_again_is_replaced(spark, tmp_path):
    folder, (path, checkpoint) = f"file://{tmp_path}/in", X.new_folders(spark, "graded")
    _sent(spark, folder, [(1, 1, 1, 0.5, 1), (2, 2, 1, 0.5, 1)])
    for _ in range(2):  # a new checkpoint: the same epoch number with the same rows
        X.grade_batches(X.open_stream(spark, folder, 64, "arrived_at"), lambda r: r, path, checkpoint + str(_))
    assert _graded(spark, path) == [(1, 1, 1, 0.5, True), (2, 2, 1, 0.5, True)]


def test_a_short_batch_leaves_when_its_time_is_over(spark, tmp_path):
    folder, (path, checkpoint) = f"file://{tmp_path}/in", X.new_folders(spark, "graded")
    grade = lambda: X.grade_batches(X.open_stream(spark, folder, 1, "arrived_at"), lambda r: r, path, checkpoint, 1, "0 seconds")
    _sent(spark, folder, [(1, 1, 1, 0.5, 3), (1, None, None, None, 3)])
    grade()
    _sent(spark, folder, [(2, 2, 1, 0.5, 1)])
    grade()
    told = lambda: {(r["batch_id"], r["complete"], r["n_rows"]) for r in X.generations(spark, path).collect()}
    assert _graded(spark, path)[-1] == (2, 2, 1, 0.5, True) and told() == {(1, False, 2), (2, True, 1)}
    _sent(spark, folder, [(2, 9, 1, 0.5, 4)])  # a short round of a batch that is whole: it does not replace it
    grade()
    _sent(spark, folder, [(3, 3, 1, 0.5, 1)])
    grade()
    assert told() == {(1, False, 2), (2, True, 1), (3, True, 1)} and (2, 2, 1, 0.5, True) in _graded(spark, path)


def test_nothing_graded_yet(spark):
    path, _ = X.new_folders(spark, "graded")
    assert X.generations(spark, path) is None and X.compact_grades(spark, path) is None
    with pytest.raises(ValueError):
        X.latest_grades(spark, path)


def test_state_settings_come_back(spark):
    from scoreweave.streaming.gate import ROCKS_DB, STORE, rocks_db

    with rocks_db(spark):
        assert spark.conf.get(STORE) == ROCKS_DB
    assert spark.conf.get(STORE, "") != ROCKS_DB


def test_decisions_survive_a_restart(spark, tmp_path):
    at = datetime(2024, 5, 1)
    made = lambda i, result, question, score, hours: (i, result, question, score, f"c{i}", at + timedelta(hours=hours))
    path, checkpoint = X.new_folders(spark, "decisions")
    folder = f"file://{tmp_path}/in"

    def arrive(*rows):
        for row in rows:
            spark.createDataFrame([row], X.DECISION).coalesce(1).write.mode("append").parquet(folder)
        X.collect_decisions(X.open_stream(spark, folder, files_per_trigger=1), path, checkpoint)

    assert X.latest_decisions(spark, path).count() == 0
    arrive(made(1, 7, 1, 0.5, 0), made(2, 7, 1, 0.75, 2), made(3, 8, None, None, 1))
    arrive()  # nothing new
    arrive(made(4, 7, 1, 0.25, 1), made(5, 9, 2, 1.0, 3), made(1, 7, 1, 0.5, 0))  # an older one, another score, a repeated id
    got = {(r["result_id"], r["question_id"]): (r["decision_id"], r["new_score"], r["comment"]) for r in X.latest_decisions(spark, path).collect()}
    assert got == {(7, 1): (2, 0.75, "c2"), (8, None): (3, None, "c3"), (9, 2): (5, 1.0, "c5")}


def test_decisions_are_applied(spark):
    from scoreweave.operators import maintain as M

    at = datetime(2024, 5, 1)
    scores = spark.createDataFrame([(1, 1, 0.5, None, True, "m", "c"), (1, 2, 0.25, None, True, "m", None),
        (2, 1, 1.0, None, True, "m", None)], "result_id long, question_id long, ai_score double, final_score double, requires_manual_review boolean, manual_review_reason string, professor_comment string")
    results = spark.createDataFrame([(1, "GRADED"), (2, "GRADED")], "result_id long, status string")
    given = spark.createDataFrame([(1, 1, 1, 0.75, None, at), (2, 1, None, None, "ok", at)], X.DECISION)
    new_results, new_scores = M.apply_decisions(results, scores, given)
    assert {tuple(r) for r in new_results.collect()} == {(1, "REVIEWED"), (2, "GRADED")}
    cols = ("result_id", "question_id", "final_score", "requires_manual_review", "manual_review_reason", "professor_comment")
    assert {tuple(r) for r in new_scores.select(*cols).collect()} == {(1, 1, 0.75, False, None, None), (1, 2, 0.25, False, None, None),
        (2, 1, None, True, "m", None)}

"""What a restart finds, resume states, contexts to rebuild, stored lines and session hits."""

import pytest
from pyspark.sql import functions as F

from linequarry.operators import projection as P
from linequarry.operators import recovery as Y


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_exports_after_restart(spark):
    jobs = spark.createDataFrame(
        [(1, "a", "writing", "w", "", True), (2, "a", "completed", "done", "", True), (3, "a", "failed", "w", "E", False), (4, "gone", "completed", "done", "", None), (5, "a", None, None, None, True), (6, "a", "cancelling", "c", "", None)],
        "export_id int, task_id string, status string, current_stage string, error_code string, has_temp boolean",
    )
    tasks = spark.createDataFrame([("a",), ("a",)], "task_id string")
    with pytest.raises(Y.NotReconciled):
        Y.check_reconciled(jobs)
    after = Y.exports_after_restart(jobs, tasks)
    Y.check_reconciled(after)
    gone = ("interrupted", "interrupted", "ENGINE_PROCESS_EXITED", True)
    assert _rows(after, "export_id", "status", "current_stage", "error_code", "interrupted", "needs_cleanup") == [
        (1, *gone, True), (2, "completed", "done", "", False, True), (3, "failed", "w", "E", False, False), (4, "completed", "done", "", False, True), (5, None, None, None, False, False), (6, *gone, False),
    ]
    again = Y.exports_after_restart(after.drop("interrupted", "needs_cleanup"), tasks)
    assert again.where("interrupted").count() == 0 and _rows(again, "export_id", "status") == _rows(after, "export_id", "status")


def test_cleanups_after_restart(spark):
    jobs = spark.createDataFrame([(t, s, n, "OLD") for t, s, n in (("done", "pending", 1), ("busy", "pending", 2), ("stuck", "pending", None), ("gone", "pending", 1), ("late", "pending", 1), ("told", "cleanup_failed", 4))], "task_id string, status string, attempt_count int, last_error_code string")
    tasks = spark.createDataFrame([(t,) for t in ("done", "busy", "stuck", "late", "told", "other")], "task_id string")
    tried = spark.createDataFrame([("done", None, True), ("busy", "IN_USE", True), ("stuck", None, False), ("gone", None, True), ("told", None, True)], "task_id string, code string, deleted boolean")
    after = Y.cleanups_after_restart(jobs, tasks, tried)
    assert _rows(after, "task_id", "outcome", "status", "attempt_count", "last_error_code") == [
        ("busy", "failed", "cleanup_failed", 3, "IN_USE"), ("done", "completed", "pending", 2, ""), ("gone", "forgotten", "pending", 1, "OLD"), ("late", "kept", "pending", 1, "OLD"), ("stuck", "failed", "cleanup_failed", 1, "DATABASE_ERROR"), ("told", "kept", "cleanup_failed", 4, "OLD"),
    ]
    assert [r.task_id for r in Y.cleanups_left(after).orderBy("task_id").collect()] == ["busy", "late", "stuck", "told"]
    assert [r.task_id for r in Y.tasks_left(tasks, after).orderBy("task_id").collect()] == ["busy", "late", "other", "stuck", "told"]


def test_resume_states(spark):
    pages = {("t", "a"): [1, 2, 4, 4, 9], ("t", "b"): [2], ("t", "c"): [1, 2, 3], ("u", "a"): [1, 0, -3], ("t", ""): [1], ("v", "z"): [0]}
    processed = spark.createDataFrame([(t, s, p) for (t, s), ps in pages.items() for p in ps], "task_id string, source_id string, page_no int")
    marks = spark.createDataFrame([("t", "a", 3), ("t", "d", 7), ("t", "", 9), (None, "a", 1), ("u", "a", None)], "task_id string, source_id string, worker_generation int")
    got = Y.task_resume_states(processed, marks, with_pages=True)
    assert _rows(got, "task_id", "source_id", "done", "last_completed_page", "next_page", "worker_generation", "processed_page_ids") == [
        ("t", "a", 4, 9, 3, 3, [1, 2, 4, 9]), ("t", "b", 1, 2, 1, 0, [2]), ("t", "c", 3, 3, 4, 0, [1, 2, 3]), ("t", "d", 0, 0, 1, 7, []), ("u", "a", 1, 1, 2, 0, [1]), ("v", "z", 0, 0, 1, 0, []),
    ]
    assert "processed_page_ids" not in Y.task_resume_states(processed, marks).columns
    assert Y.task_resume_states(processed.limit(0), marks.limit(0)).count() == 0


def test_contexts_to_rebuild(spark):
    rows = [("t", "s1", 1, 1, 2, "ready"), ("t", "s1", 1, 2, 1, "ready"), ("t", "s1", 2, 3, 2, "pending"), ("t", "s2", 1, 4, None, None), ("t", "s2", 1, 5, 1, "failed"), ("t", "s2", 3, 6, 2, "uncertain"), ("u", "s2", 1, 1, 2, None)]
    found = spark.createDataFrame(rows, "task_id string, source_id string, page_no int, global_sequence int, layout_context_version int, layout_context_status string")
    assert _rows(Y.stale_layouts(found, 2), "task_id", "global_sequence") == [("t", 2), ("t", 3), ("t", 4), ("u", 1)]
    assert _rows(Y.stale_layouts(found, 2, 1), "task_id", "global_sequence") == [("t", 2), ("u", 1)]
    assert _rows(Y.stale_layouts(found, 2, 1, "s2", 1), "task_id", "global_sequence") == [("t", 4), ("u", 1)]
    assert _rows(Y.stale_layouts(found, 3, 200), "task_id", "global_sequence") == [("t", 1), ("t", 2), ("t", 3), ("t", 4), ("t", 6), ("u", 1)]
    for limit in (0, 201, True, 2.0):
        with pytest.raises(ValueError):
            Y.stale_layouts(found, 2, limit)


def test_failures_count_before_they_are_read(spark):
    rows = [("t", n, p) for n, p in enumerate(['{"k": 1}', "{broken", "[1]", "null", None, '{"k": 2}', "3", '{"k": 4}'])]
    failures = spark.createDataFrame(rows, "task_id string, sequence int, payload string")
    assert _rows(Y.task_failures(failures), "sequence") == [(0,), (5,), (7,)]
    assert _rows(Y.task_failures(failures, 6), "sequence") == [(0,), (5,)]


def test_stored_lines_with_odd_columns(spark):
    names = [f"{c}_json" for c in P.LINE_KINDS]
    good = ("[[0,0],[2,0],[2,1],[0,1]]", "[[[0,0],[1,0],[1,1],[0,1]]]", '["é"]', "[0.5]", '[{"text":"é","confidence":0.25}]', '[{"index":0,"source":"e","resolved":"é"}]', '{"method":"vote","confidence":0.75}')
    df = spark.createDataFrame([(1, *good), (2, *[None] * 7), (3, *[""] * 7), (4, *["{["] * 7), (5, "[", *good[1:])], "line_no int, " + ", ".join(f"{c} string" for c in names))
    got = {r.line_no: r for r in P.decoded_lines(df).collect()}
    one = got[1]
    assert one.bbox[2] == [2.0, 1.0] and one.word_boxes[0][1] == [1.0, 0.0] and one.word_text == ["é"] and one.word_confidences == [0.5] and one.isolated_top_k[0].confidence == 0.25
    assert one.script_reconciliations[0].resolved == "é" and one.correction_provenance.method == "vote" and one.undecodable == []
    for n in (2, 3):
        assert all(got[n][c] is None for c in P.LINE_KINDS) and got[n].undecodable == []
    assert got[4].undecodable == list(P.LINE_KINDS) and all(got[4][c] is None for c in ("bbox", "word_boxes", "word_text"))
    assert got[5].undecodable == ["bbox"] and got[5].bbox is None and got[5].word_text == ["é"]


def test_session_hits_fall_back_to_the_whole_page(spark):
    hits = spark.createDataFrame([("t", 1, 0, 1, 2, 0), ("t", 1, 1, 0, 1, 0), ("t", 1, 2, 0, 1, 1), ("t", 9, 9, 0, 1, 0)], "task_id string, doc_id int, line_no int, start int, end int, layer_priority int")
    line = "doc_id int, line_no int, source_id string, page_no int, line_index int, raw_text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
    lined = spark.createDataFrame([(1, 0, "s", 1, 0, "abcd", 10.0, 0.0, 50.0, 5.0, 40.0, 10.0), (1, 1, "s", 1, 1, "ab", 10.0, 0.0, 50.0, 5.0, 0.0, 10.0), (1, 2, "r", 1, 2, "ab", None, None, None, None, 40.0, 10.0)], line)
    sources = spark.createDataFrame([("t", "s", "a/b.png"), ("u", "r", "other")], "task_id string, source_id string, display_path string")
    got = _rows(P.session_hits(hits, lined, sources), "line_no", "display_path", *[f"normalized_{c}" for c in ("x0", "y0", "x1", "y1")])
    assert got == [(0, "a/b.png", 0.5, 0.0, 0.75, 0.5), (1, "a/b.png", 0.0, 0.0, 1.0, 1.0), (2, "r", 0.0, 0.0, 1.0, 1.0)]
    assert P.session_hits(hits, lined, sources).orderBy(*P.SESSION_ORDER).select(F.first("line_no")).first()[0] == 0

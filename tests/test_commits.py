"""Commits of pages and sessions, pins and exports, numbers without a window per task."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.operators import export, pages as P
from linequarry.operators.numbering import counted_out, numbered
from linequarry.operators.store import AlreadyCommitted, BatchRefused, Committed, append_numbered, added, fill_gaps


class Lost(Exception):
    pass


def lost():
    raise Lost


def _records(spark, rows):
    """rows: task, source, page, generation, texts."""
    return spark.createDataFrame([(t, s, p, g, [(i, i, x, 0.9) for i, x in enumerate(texts)]) for t, s, p, g, texts in rows], P.RECORD)


def _state(store):
    s = store.pin()
    rows = lambda name, *cols: sorted(tuple(r) for r in s.read(name).select(*cols).collect())
    return rows("processed", *P.PAGE), rows("occurrences", "task_id", "global_sequence", "source_id", "page_no", "line_no", "start"), rows("events", "task_id", "sequence")


def test_page_commits_replayed_and_lost(spark, tmp_path):
    store = Committed(spark, f"file://{tmp_path}/s")
    one = _records(spark, [("a", "d1", 1, 1, ["ring ring", "none"]), ("a", "d1", 2, 1, ["a ring"]), ("b", "d2", 1, 1, ["no"])])
    two = _records(spark, [("a", "d0", 1, 1, ["ring"]), ("a", "d1", 2, 1, ["other ring ring"]), ("b", "d2", 2, 1, ["ring"]), ("b", "d2", 2, 1, ["ring"])])
    with pytest.raises(Lost):
        P.commit_pages(store, one, "e0", "ring", between=lost)
    assert store.batches() == [] and store.read("pages") is None  # the data lies there, nobody sees it
    for key, batch in (("e0", one), ("e0", one), ("e1", two), ("e1", two), ("e2", one)):
        P.commit_pages(store, batch, key, "ring")
    done, hits, events = _state(store)
    assert done == [("a", "d0", 1), ("a", "d1", 1), ("a", "d1", 2), ("b", "d2", 1), ("b", "d2", 2)]
    assert hits == [("a", 1, "d1", 1, 0, 0), ("a", 2, "d1", 1, 0, 5), ("a", 3, "d1", 2, 0, 2), ("a", 4, "d0", 1, 0, 0), ("b", 1, "d2", 2, 0, 0)]
    assert events == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert {(r.task_id, r.pages_done) for r in store.read("checkpoints").collect()} == {("a", 2), ("b", 1), ("a", 3), ("b", 2)}
    # a worker of an older generation is too late; a page without a number is refused
    P.commit_pages(store, _records(spark, [("a", "d9", 1, 5, ["x"])]), "e3", "ring")
    P.commit_pages(store, _records(spark, [("a", "d8", 1, 4, ["ring"])]), "e4", "ring")
    assert ("a", "d8", 1) not in _state(store)[0] and ("a", "d9", 1) in _state(store)[0]
    with pytest.raises(BatchRefused):
        P.commit_pages(store, _records(spark, [("a", None, 1, 9, ["x"])]), "e5", "ring")


def test_writers_at_once_leave_no_double(spark, tmp_path):
    """Several writers, some with the same pages: every page once, numbers from 1 without gaps."""
    root, wrong = f"file://{tmp_path}/s", []
    batches = [_records(spark, [("a", f"d{d}", p, 1, ["ring and ring"]) for d in some for p in (1, 2)]) for some in ((1, 2), (2, 3), (3, 4))]

    def write(n):
        try:
            P.commit_pages(Committed(spark, root), batches[n], f"w{n}", "ring")
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong
    done, hits, events = _state(Committed(spark, root))
    assert len(done) == len(set(done)) == 8
    assert [h[1] for h in hits] == list(range(1, 17)) and [e[1] for e in events] == list(range(1, 9))


def test_dead_entry_and_taken_number(spark, tmp_path):
    store = Committed(spark, f"file://{tmp_path}/s")
    store.commit({"t": spark.range(2)}, "one")
    (tmp_path / "s" / "manifest" / "000000000001").write_bytes(b"")  # a writer that died in its entry
    assert store.commit({"t": spark.range(3)}, "two") == "two" and store.read("t").count() == 5
    with pytest.raises(AlreadyCommitted):
        store.commit({"t": spark.range(1)}, "two", new=True)
    assert store.batches() == ["one", "two"]


def test_sessions(spark, tmp_path):
    store = Committed(spark, str(tmp_path))
    hits = spark.createDataFrame([("d1", 0, 3), ("d1", 0, 9)], "source_id string, line_no int, start int")
    key = ["source_id", "line_no", "start"]
    P.save_session(store, "s1", "q", hits, key)
    for session, rows, between, error in (("s1", hits, None, AlreadyCommitted), ("s2", hits.unionAll(hits), None, BatchRefused), ("s3", hits, lost, Lost)):
        with pytest.raises(error):
            P.save_session(store, session, "q", rows, key, between)
    assert [tuple(r) for r in store.read("sessions").select("session_id", "n_hits").collect()] == [("s1", 2)] and store.read("session_hits").count() == 2
    P.save_session(store, "s3", "q", hits.limit(0), key)  # the lost one can be saved
    assert {(r.session_id, r.n_hits) for r in store.read("sessions").collect()} == {("s1", 2), ("s3", 0)}


def test_pin_does_not_move(spark, tmp_path):
    store = Committed(spark, str(tmp_path))
    assert store.pin().totals("t", ["p"]) == {"total": 0, "pages": 0} and list(store.pin().in_batches("t", ["n"])) == []
    rows = spark.range(1234).select(F.col("id").alias("n"), (F.col("id") % 7).alias("p"))
    store.commit({"t": rows})
    pin, seen = store.pin(), []
    for k, batch in enumerate(pin.in_batches("t", ["n"])):
        if k == 0:
            store.commit({"t": rows})  # another writer, in the middle of the export
        assert len(batch) == 500 or k == 2
        seen += [r.n for r in batch]
    assert seen == list(range(1234)) and pin.totals("t", ["p"]) == {"total": 1234, "pages": 7} and store.pin().totals("t", ["p"])["total"] == 2468


def test_numbers_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), r.randint(0, 400), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "s string, v int, n int").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = numbered(df, ["s"], ["v", "n"], "place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in ("hot", "x", None):
        want = sorted((v, n) for t, v, n in rows if t == s)
        assert [(x.v, x.n) for x in sorted((x for x in got if x.s == s), key=lambda x: x.place)] == want
        assert sorted(x.place for x in got if x.s == s) == list(range(1, len(want) + 1))
    assert numbered(df.limit(0), ["s"], ["v"], "place").count() == 0
    sizes = spark.createDataFrame([("a", 70_000), ("b", 0), ("c", 1)], "s string, n long")
    assert {(x.s, x["count"]) for x in counted_out(sizes, ["s"], "n", "k").groupBy("s").count().collect()} == {("a", 70_000), ("c", 1)}


def test_appends_and_gaps_in_a_hot_scope(spark):
    df = spark.range(2000).select(F.lit("t").alias("task_id"), F.col("id").alias("k"))
    old = append_numbered(None, df.where("k % 2 = 0"), ["task_id", "k"], ["k"])
    new = append_numbered(old, df, ["task_id", "k"], ["k"])
    assert added(old, new) == 1000 and [r.k for r in new.orderBy("global_sequence").collect()] == [*range(0, 2000, 2), *range(1, 2000, 2)]
    rows = spark.createDataFrame([("t", n, (n * 7) % 50 if n % 3 else None) for n in range(200)], "task_id string, id int, num int")
    got = {r.id: r.num for r in fill_gaps(rows, "task_id", "num", ["id"]).collect()}
    held, want = {}, {}
    for n in range(200):
        v = (n * 7) % 50 if n % 3 else None
        if v is not None and 1 <= v <= 200 and v not in held:
            held[v] = want[n] = v
    free = iter(v for v in range(1, 201) if v not in held)
    want |= {n: next(free) for n in range(200) if n not in want}
    assert got == want


def test_one_file_from_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "BLOCK_BYTES", 300)
    rows = spark.range(1000).select(F.col("id").alias("global_sequence"), F.concat(F.lit("é😀</script>"), "id").alias("text"), F.lit(None).cast("string").alias("none")).repartition(7)
    size = export.write_json({"id": 1}, rows, f"{tmp_path}/a.json")
    raw = (tmp_path / "a.json").read_bytes()
    told = json.loads(raw)
    assert len(raw) == size and [o["global_sequence"] for o in told["occurrences"]] == list(range(1000)) and told["occurrences"][5] == {"global_sequence": 5, "text": "é😀</script>5", "none": None}
    assert told["integrity"]["occurrences"] == 1000 and told["integrity"]["bytes"] == len(raw[raw.index(b"[\n") + 2 : raw.rindex(b"\n]")])
    export.write_json({}, rows.limit(0), f"{tmp_path}/b.json")
    assert json.loads((tmp_path / "b.json").read_text())["occurrences"] == []
    pages = spark.createDataFrame([(2, "p2"), (1, "p1"), (1, "p1")], "page_id int, name string")
    export.write_html("t", rows, pages, f"{tmp_path}/c.html")
    text = (tmp_path / "c.html").read_text()
    data = json.loads(text.split('type="application/json">')[1].split("</script>")[0])
    assert [p["page_id"] for p in data["pages"]] == [1, 2] and len(data["hits"]) == 1000 and data["facts"]["hits"] == 1000 and text.count("</script>") == 2
    assert not [f for f in tmp_path.iterdir() if f.suffix == ".tmp"]


def test_page_of_fifty_thousand_lines():
    """Memory goes with the lines: 50,000 of them in ten columns, and the same in one row."""
    from linequarry.operators.layout import blocks

    n = np.arange(50_000)
    col, row = n // 5000, n % 5000
    box = np.stack([col * 500.0, row * 30.0, col * 500.0 + 400, row * 30.0 + 24], axis=1)
    label = blocks(box, False)
    assert (label == col * 5000).all()
    flat = np.stack([n * 10.0, np.zeros(50_000), n * 10.0 + 8, np.full(50_000, 24.0)], axis=1)
    assert (blocks(flat, False) == n).all()
    assert (blocks(np.repeat(flat[:1], 50_000, axis=0), False) == 0).all()


def test_islands_tell_apart_what_cannot_merge(spark):
    from linequarry.operators.layout import _islands, greedy_merge

    rows = [("hot", float(x)) for k in range(40) for x in range(k * 100, k * 100 + 60, 5)] + [("b", 1.0)]
    got = _islands(spark.createDataFrame(rows, "s string, v double").repartition(6), ["s"], "v", 8.0, "i").collect()
    assert {(r.s, int(r.v // 100)): r.i for r in got if r.s == "hot"} == {("hot", k): k for k in range(40)} and len({(r.s, r.i) for r in got}) == 41
    many = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("ordinal"), F.lit("pdf_ocr").alias("source"), (F.col("id") % 5000 * 20).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") % 5000 * 20 + 6).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    got = greedy_merge(many, ["file"]).collect()
    assert len(got) == 5000 and {r.n for r in got} == {4} and sorted(r.ordinal for r in got) == list(range(5000))

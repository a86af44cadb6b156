import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linequarry.functions import geometry as G
from linequarry.functions import variants as V
from linequarry.operators import layout as L
from linequarry.operators import review as R
from linequarry.operators import search as S
from linequarry.operators import sources
from linequarry.operators import store as T
from linequarry.streaming import events as E


@pytest.mark.parametrize("text,kind", [("亏空", "simplified"), ("虧空", "traditional"), ("空", "neutral"), ("亏虧", "mixed")])
def test_script_class(spark, text, kind):
    assert V.HAN.classify(text) == kind
    assert spark.createDataFrame([(text,)], "t string").select(V.classify_column(F.col("t"), V.HAN).alias("x")).first().x == kind


def test_forms_phrases_and_families():
    assert V.HAN.forms("头发")["traditional"] == "頭髮"
    assert V.HAN.phrase_evidence("头发")["traditional"] == "頭髮"
    assert V.HAN.same_family("虧", "亏") and not V.HAN.same_family("亏", "亏") and not V.HAN.same_family("亏", "约")
    assert V.HAN.variants("里") == ["裏", "裡"] and V.HAN.has_variant("发") and not V.HAN.has_variant("空")
    assert V.LATIN.convert("Straße é", "simplified") == "Strasse e"
    assert V.HAN.query_graph("头发")["status"] == "phrase"


def test_layers_best_hit_and_unmapped(spark):
    rows = [(1, "亏空", "亏空"), (2, "虧空", "虧空"), (3, "虧空", "亏空")]
    df = spark.createDataFrame(rows, "id int, raw_text string, resolved_text string")
    got = {r.id: (r.layer, r.start, r.end) for r in S.layered_search(df, "亏空", V.HAN).collect()}
    assert got == {1: ("raw_exact", 0, 2), 2: ("variant_graph", 0, 2), 3: ("context_resolved", 0, 2)}
    df = spark.createDataFrame([(1, "Maße", "Maße")], "id int, raw_text string, resolved_text string")
    hit = S.layered_search(df, "asse").first()
    assert (hit.layer, hit.start, hit.index_start) == ("variant_graph", None, 1)


def test_numbers_are_never_used_up_by_duplicates(spark):
    first = T.append_numbered(None, spark.createDataFrame([("t", "p5"), ("t", "p5")], "task_id string, k string"), ["task_id", "k"], ["k"])
    both = T.append_numbered(first, spark.createDataFrame([("t", "p5"), ("t", "p1")], "task_id string, k string"), ["task_id", "k"], ["k"])
    assert sorted((r.k, r.global_sequence) for r in both.collect()) == [("p1", 2), ("p5", 1)]


def test_gaps_are_filled_whatever_the_order(spark):
    rows = [("t", i, n) for i, n in enumerate([None, 3, 3, None, 9, 1])]
    wanted = {0: 2, 1: 3, 2: 4, 3: 5, 4: 6, 5: 1}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = T.fill_gaps(spark.createDataFrame(rows, "task_id string, id int, num int"), "task_id", "num", ["id"]).collect()
        assert {r.id: r.num for r in got} == wanted


def test_batch_decisions_are_all_or_nothing(spark):
    known = spark.createDataFrame([(1,), (2,)], "id int")
    now = spark.createDataFrame([(1, "rejected")], "id int, decision string")
    ledger = spark.createDataFrame([], "operation_id string, request_hash string, created_at timestamp")
    changes = spark.createDataFrame([(1, "confirmed"), (2, None)], "id int, decision string")
    after, ledger2 = T.apply_decisions(now, changes, known, ledger, "id", "op1")
    assert sorted(map(tuple, after.collect())) == [(1, "confirmed"), (2, None)]
    same, _ = T.apply_decisions(after, changes, known, ledger2, "id", "op1")
    assert sorted(map(tuple, same.collect())) == [(1, "confirmed"), (2, None)]
    for bad in ([(3, "confirmed")], [(1, "confirmed"), (1, "rejected")]):
        with pytest.raises(T.BatchRefused):
            T.apply_decisions(now, spark.createDataFrame(bad, "id int, decision string"), known, ledger, "id", "op2")
    with pytest.raises(T.BatchRefused):
        T.apply_decisions(now, spark.createDataFrame([(1, "rejected")], "id int, decision string"), known, ledger2, "id", "op1")


def test_review_log_may_set_back_to_null(spark):
    log = spark.createDataFrame([(1, 1, True, "confirmed", True, "n"), (1, 2, False, None, False, None), (1, 3, True, None, False, None)], "id int, op int, sets_decision boolean, decision string, sets_note boolean, note string")
    assert tuple(T.latest_reviews(log, ["id"], "op").first()) == (1, None, "n", 3)


def test_committed_batches(spark, tmp_path):
    store = T.Committed(spark, str(tmp_path))
    key = store.commit({"lines": spark.range(3), "hits": spark.range(2)}, "b1")
    assert store.commit({"lines": spark.range(9)}, "b1") == key and store.read("lines").count() == 3
    snapshot = store.batches()
    spark.range(5).write.parquet(f"{tmp_path}/lines/batch=orphan")
    store.commit({"lines": spark.range(4)})
    assert store.read("lines").count() == 7 and store.read("lines", snapshot).count() == 3 and store.read("none") is None


@pytest.mark.parametrize("size", [0, 1, 99, 100, 199, 200, 201])
def test_pages_have_no_gap(spark, size):
    rows = spark.range(1, size + 1).withColumnRenamed("id", "n")
    by_offset = [r.n for o in range(0, size + 1, 100) for r in R.page(rows, ["n"], 100, o).collect()]
    by_key, last = [], 0
    while got := [r.n for r in R.after(rows, "n", last, 100).collect()]:
        by_key += got
        last = got[-1]
    assert by_offset == by_key == list(range(1, size + 1))


@pytest.mark.parametrize("limit,offset", [(0, 0), (201, 0), (True, 0), (1.5, 0), (1, -1), (1, True)])
def test_page_parameters(spark, limit, offset):
    with pytest.raises(ValueError):
        R.page(spark.range(1), ["id"], limit, offset)


def test_first_missing_page(spark):
    for pages in ([1, 2, 4], [2, 3], [1, 2, 3], [0, -1, 5], [1, 1, 2]):
        row = E.resume_states(spark.createDataFrame([("s", p) for p in pages], "s string, page int"), ["s"], "page").collect()
        wanted = next(i for i in range(1, 99) if i not in pages)
        assert row[0].next_page == wanted


def test_fold_stops_at_the_first_end(spark):
    rows = [(1, 1, "created"), (1, 2, "completed"), (1, 3, "progress"), (2, 1, "created"), (2, 2, "progress")]
    got = {r.task_id: (r.status, r.last_sequence, r.progressed) for r in E.fold(spark.createDataFrame(rows, "task_id long, sequence long, kind string")).collect()}
    assert got == {1: ("completed", 2, 0), 2: ("progress", 2, 1)}
    assert E.can_move("draft", "queued") and not E.can_move("completed", "running")


def test_liveness(spark):
    rows = [("running", True, "2024-01-01 00:00:00", False), ("running", True, "2023-12-31 23:00:00", False), ("running", False, "2024-01-01 00:00:00", False), ("stopped", True, None, False), ("failed", True, None, False), ("failed", True, None, True), ("queued", False, None, False)]
    df = spark.createDataFrame(rows, "status string, alive boolean, heartbeat string, reported boolean")
    assert [r.live for r in E.liveness(df, F.lit("2024-01-01 00:01:00")).collect()] == ["running", "stale", "stale", "unknown", "failed", "completed", "queued"]


def test_blocks_against_search():
    r = np.random.default_rng(2)
    for _ in range(20):
        p = r.uniform(0, 300, (25, 2))
        box = np.hstack([p, p + r.uniform(5, 40, (25, 2))])
        label = L.blocks(box, False)
        h = box[:, 3] - box[:, 1]
        linked = lambda i, j: max(0, min(box[i, 2], box[j, 2]) - max(box[i, 0], box[j, 0])) >= 0.28 * min(box[i, 2] - box[i, 0], box[j, 2] - box[j, 0]) and max(0, max(box[i, 1], box[j, 1]) - min(box[i, 3], box[j, 3])) <= 2.6 * np.median(h)  # noqa: E731,B023
        for i in range(25):
            seen, todo = {i}, [i]
            while todo:
                k = todo.pop()
                more = [j for j in range(25) if j not in seen and linked(k, j)]
                seen.update(more)
                todo += more
            assert label[i] == min(seen)


def test_greedy_merge_is_ordered(spark):
    rows = [("f", 1, "pdf_ocr", 0.0, 0.0, 10.0, 10.0), ("f", 2, "pdf_text_layer", 2.0, 0.0, 12.0, 10.0), ("f", 3, "pdf_ocr", 9.0, 0.0, 19.0, 10.0), ("f", 4, "pdf_ocr", 40.0, 0.0, 50.0, 10.0)]
    got = L.greedy_merge(spark.createDataFrame(rows, "file string, ordinal long, source string, x0 double, y0 double, x1 double, y1 double"), ["file"]).collect()
    assert sorted((r.ordinal, r.sources, r.n) for r in got) == [(2, "pdf_ocr,pdf_text_layer", 3), (4, "pdf_ocr", 1)]


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    f = lambda v: F.lit(float(v))
    assert one(G.orientation(f(0), f(0), f(10), f(10))[0]) == "vertical"
    poly = F.array(F.array(f(1), f(2)), F.array(f(5), f(2)), F.array(f(5), f(9)))
    assert tuple(one(G.polygon_box(poly))) == (1.0, 2.0, 5.0, 9.0)
    assert one(G.polygon_box(F.array(F.array(f(1), f(2))))) is None
    assert [list(p) for p in one(G.rotated(poly, f(100)))] == [[98.0, 1.0], [98.0, 5.0], [91.0, 5.0]]
    assert one(G.box_hash(f(0.1), f(0.2))) == one(G.box_hash(f(0.1), f(0.2 + 1e-12)))


def test_folder_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.djvu").write_bytes(b"nothing")
    (tmp_path / "z.txt").write_bytes(b"-")
    found = sources.scan_folder(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.ok for r in found.select("path", sources.signature_matches(F.col("path"), F.col("content")).alias("ok")).collect()}
    assert got == {"x.PDF": True, "y.djvu": False}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "w.png").write_bytes(b"-")
    assert sources.scan_folder(spark, str(tmp_path), skip=[f"{tmp_path}/out"]).count() == 2


def test_commit_numbers_are_not_given_twice(spark, tmp_path):
    from linequarry.operators import store as T

    df = spark.range(3)
    a, b = T.Committed(spark, str(tmp_path)), T.Committed(spark, f"file://{tmp_path}")
    names = [a.commit({"t": df}), b.commit({"t": df}), a.commit({"t": df}, "k"), b.commit({"t": df}, "k")]
    assert names[2:] == ["k", "k"] and a.batches() == b.batches() == [*names[:2], "k"]
    assert a.read("t").count() == 9 and a.read("t", names[:1]).count() == 3 and a.read("other") is None


def test_greedy_merge_against_a_plain_loop(spark):
    import random

    from linequarry.operators.layout import greedy_merge

    r = random.Random(3)
    rows = [(f"g{k % 7}", k, r.choice(["pdf_ocr", "pdf_text_layer"]), x := float(r.randint(0, 30)), y := float(r.randint(0, 12)), x + 6, y + 10) for k in range(160)]
    want = []
    for g in sorted({x[0] for x in rows}):
        kept = []
        for row in (x for x in rows if x[0] == g):
            for rep in kept:
                (x0, y0, x1, y1), (a0, b0, a1, b1) = rep["box"], row[3:]
                apart = abs((x0 + x1 - a0 - a1) / 2) + abs((y0 + y1 - b0 - b1) / 2)
                if apart <= 8 and (min(y1, b1) - max(y0, b0)) / min(y1 - y0, b1 - b0) >= 0.8:
                    rep["from"].add(row[2])
                    rep["n"] += 1
                    if row[2] == "pdf_text_layer" and rep["kind"] != "pdf_text_layer":
                        rep.update(kind=row[2], box=row[3:], ordinal=row[1])
                    break
            else:
                kept.append({"box": row[3:], "from": {row[2]}, "kind": row[2], "n": 1, "ordinal": row[1]})
        want += [(g, k["ordinal"], ",".join(sorted(k["from"])), k["n"]) for k in kept]
    df = spark.createDataFrame(rows, "file string, ordinal long, source string, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(x) for x in greedy_merge(df.repartition(3), ["file"]).select("file", "ordinal", "sources", "n").collect()]
    assert sorted(got) == sorted(want)


def test_number_aware_order(spark):
    from linequarry.operators.review import number_aware

    names = ["b2", "a10.pdf", "A9.pdf", "a009b", "a1", "b12", "b02x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(number_aware(F.col("n")), "n").collect()] == ["a1", "A9.pdf", "a009b", "a10.pdf", "b2", "b02x", "b12"]


def test_spatial_context_directions(spark):
    from linequarry.operators.projection import spatial_context

    boxed = spark.createDataFrame([(1, 1, 0, "ab cd", 0.0, 0.0, 50.0, 10.0), (1, 1, 1, "efg", 0.0, 20.0, 50.0, 30.0), (1, 1, 2, "h i", 0.0, 40.0, 50.0, 50.0)], "doc_id long, page_no int, line_no int, raw_text string, x0 double, y0 double, x1 double, y1 double")
    hits = spark.createDataFrame([(1, 1, 1, 1, 2)], "doc_id long, page_no int, line_no int, start int, end int")
    one = lambda **how: tuple(spatial_context(hits, boxed, **how).select("before", "after").first())
    assert one() == ("ab cd\ne", "g\nh i")
    assert one(radius=2) == ("d\ne", "g\nh")
    assert one(direction="rtl") == ("dc ba\ng", "e\ni h")

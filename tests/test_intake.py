"""Checks on what enters the corpus, held against plain versions."""

import pytest
from pyspark.sql import functions as F

from linequarry.functions import geometry as G
from linequarry.functions import variants as V
from linequarry.operators import intake as I
from linequarry.operators import search as S

FILES = "ordinal long, path string, size long, mtime long, device long, inode long, matches boolean, size_after long, mtime_after long"


def test_files_of_a_scan(spark):
    rows = [
        (0, "a.txt", 1, 1, 1, 7, True, 1, 1),  # unsupported, and not the first of its inode
        (1, "a.pdf", 1, 1, 1, 7, True, 1, 1),
        (2, "b.PDF", 1, 1, 1, 7, True, 1, 1),
        (3, "c.pdf", 1, 1, 2, 7, False, 1, 1),
        (4, "d.pdf", 1, 1, 1, 0, True, 1, 2),
        (5, "e.pdf", 1, 1, 1, 0, True, None, 1),
        (6, "f" * 240 + ".png", 1, 1, 1, 0, True, 1, 1),
        (7, None, 1, 1, None, None, None, 1, 1),
    ]
    checked = I.checked_files(spark.createDataFrame(rows, FILES))
    got = {r.ordinal: r.state for r in checked.collect()}
    assert got == {0: "unsupported", 1: "ok", 2: "duplicate", 3: "signature", 4: "changed", 5: "changed", 6: "ok", 7: "unsupported"}
    assert [r.ordinal for r in checked.where("long_path").collect()] == [6]
    assert {r.state: (r.total, r.paths) for r in I.problem_details(checked, 1).collect()} == {"signature": (1, ["c.pdf"]), "changed": (2, ["d.pdf"])}
    assert I.checked_files(spark.createDataFrame([], FILES)).count() == 0


def test_list_of_files(spark):
    made = lambda paths: spark.createDataFrame(list(enumerate(paths)), "ordinal long, path string")
    assert [r.path for r in I.accepted_files(made(["B.pdf", "a.png", "b.PDF"])).orderBy("ordinal").collect()] == ["b.pdf", "a.png"]
    for paths, outcome in (([], "none"), ([f"{n}.pdf" for n in range(3)], "too_many"), (["a.pdf", "x.txt", ""], "invalid")):
        assert I.list_outcome(made(paths), 2).first().outcome == outcome
        with pytest.raises(I.ListRefused):
            I.accepted_files(made(paths), 2)
    seen = I.list_outcome(made([f"{n}.txt" for n in range(7)])).first()
    assert seen.invalid == 7 and seen.preview == "; ".join(f"{n}.txt: unsupported_format" for n in range(5)) + "; ..."


def test_images(spark):
    rows = [("a.tif", "tiff", 5000, 30000, 6666), ("a.tif", "tiff", 5001, 1, 1), ("a.tif", "tiff", 1, 30000, 6667), ("a.png", "png", 2, 1, 1), ("a.jpg", "png", 1, 1, 1), ("a.jpg", None, 1, 1, 1), ("a.pdf", "pdf", 1, 1, 1), ("a.png", "png", 1, 30001, 1), ("a.png", "png", 1, 0, 1)]
    told = spark.createDataFrame(rows, "p string, f string, n int, w int, h int").select(I.image_problem(F.col("p"), F.col("f"), F.col("n"), F.col("w"), F.col("h")).alias("x"))
    assert [r.x for r in told.collect()] == [None, "too_many_frames", "pixels", "several_frames", "format_mismatch", "format_mismatch", "unsupported", "edge", "empty"]


def test_paths_differ(spark):
    rows = [(0, "a/x", "x"), (1, "a/x", "x"), (2, None, "x"), (3, "", "y"), (4, "source-002/x", "x"), (1200, "a/x", "x")]
    got = [r.relative_path for r in I.unique_paths(spark.createDataFrame(rows, "ordinal long, path string, name string")).orderBy("ordinal").collect()]
    assert got == ["a/x", "source-002/x", "source-003/x", "source-004/y", "source-005/x", "source-1201/x"]


def test_word_boxes(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    words = [(0.0, 5.0, 4.0, 9.0), (5.0, 4.0, 9.0, 8.0), None]
    rows = [(words, (0.0, 0.0, 99.0, 9.0), s, e) for s, e in ((0, 2), (1, 3), (2, 3), (1, 1), (0, 4), (-1, 1), (None, 1))] + [(None, (0.0, 0.0, 99.0, 9.0), 0, 1)]
    df = spark.createDataFrame(rows, f"w array<{box}>, l {box}, s int, e int")
    got = [tuple(r.b) for r in df.select(G.match_box(F.col("w"), F.col("l"), F.col("s"), F.col("e")).alias("b")).collect()]
    assert got == [(0.0, 4.0, 9.0, 9.0), (5.0, 4.0, 9.0, 8.0)] + [(0.0, 0.0, 99.0, 9.0)] * 6


@pytest.mark.parametrize("scope", ["both", "simplified", "traditional"])
def test_scan_spans(spark, scope):
    terms = ["約", "头发"]
    texts = ["约約约定", "頭髮与头发", "", None, "無", "約頭发"]
    got = [[(h.start, h.end) for h in r.h] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.scan_spans(F.col("t"), terms, scope, V.HAN).alias("h")).collect()]

    def plain(text):
        found = set()
        for term in terms:
            for a, b in [(text, term), *((V.HAN.forms(text)[k], V.HAN.forms(term)[k]) for k in S.FORMS)]:
                if len(a) == len(text):
                    found |= {(i, i + len(b)) for i in range(len(a)) if a.startswith(b, i)}
        return sorted(x for x in found if scope == "both" or V.HAN.classify(text[x[0] : x[1]]) in ("neutral", scope))

    assert got == [plain(t or "") for t in texts] and any(got)

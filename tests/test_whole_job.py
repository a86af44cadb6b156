"""Queries over small tables whose later lines, pages and documents matter, held against plain versions."""

import math
import random
import statistics

import pytest

from linequarry.functions import variants as V
from linequarry.operators import layout as L
from linequarry.queries import QUERIES

TAIL = " ring é è 😀 àß, ena and éna ring" * 5
TEXTS = {k: "\n".join(f"{'ring ' * (n % 3)}{k} {n}{TAIL if (k + n) % 2 else ''}" for n in range(13)) for k in (*range(1, 12), 35)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en", f"src{k % 2}", len(t)) for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in TEXTS if k % 3], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    return d


def plain_lines():
    return [(k, n, t) for k, text in TEXTS.items() for n, t in enumerate(text.split("\n"))]


def test_code_points_of_whole_lines(spark, tables):
    got = {(r.doc_id, r.line_no): r.cps for r in QUERIES["i_codepoint_sequence"](spark, tables).collect()}
    assert got == {(k, n): " ".join(f"U+{ord(c):04X}" for c in t) for k, n, t in plain_lines()}


def test_whole_lines_are_reconciled(spark, tables):
    fold = str.maketrans(V.ACCENTED, V.FOLDED)
    got = {(r.doc_id, r.line_no): r.text for r in QUERIES["i_reconcile_glyphs"](spark, tables).collect()}
    assert got == {(k, n): t.translate(fold) if 60 + (k * 7 + n * 13) % 41 <= 82 else t for k, n, t in plain_lines()}
    assert any(len(t) > 20 and got[k, n] != t for k, n, t in plain_lines())


def plain_box(k, n, t):
    top, wide = 40.0 + 30 * (n % 5), 40.0 + 8 * len(t)
    return (top, 40.0, top + 24, wide) if k % 5 == 0 else (40.0, top, wide, top + 24)


def test_every_line_is_validated(spark, tables):
    wanted = []
    for k, n, t in plain_lines():
        x0, y0, x1, y1 = plain_box(k, n, t)
        rules = ["duplicate_id"] + ["code_points"] * (n % 7 == 0 and "è" in t) + ["box_outside"] * (max(x0, x1) > 1200 or max(y0, y1) > 1600)
        rules += ["page_missing"] * (k % 40 >= 30) + ["family"] * (n % 11 == 0 and t.upper() != t)
        wanted.append((k, ",".join(rules)))
    assert sorted((r.id, r.rules) for r in QUERIES["d_validation_rules"](spark, tables).collect()) == sorted(wanted)
    assert {x for _, rules in wanted for x in rules.split(",")} == {"duplicate_id", "code_points", "box_outside", "page_missing", "family"}


def plain_hits(term):
    """(task_id, doc_id, line_no, start) of every match."""
    return sorted((f"src{k % 2}", k, n, s) for k, n, t in plain_lines() for s in range(len(t)) if t.startswith(term, s))


def test_export_holds_every_occurrence_and_the_total(spark, tables):
    hits = plain_hits("ena")
    decision = lambda k: None if k % 3 == 0 else "needs_review" if k % 5 == 0 else "confirmed" if k % 2 else "rejected"
    wanted = []
    for task in ("src0", "src1"):
        mine = [h for h in hits if h[0] == task]
        pages = len({(k, n // 5) for _, k, n, _ in mine})
        wanted += [(task, i, decision(k), f"doc {k}", len(mine), pages) for i, (_, k, _, _) in enumerate(mine, 1)]
    got = QUERIES["e_export_snapshot"](spark, tables).select("task_id", "global_sequence", "decision", "display_path", "total", "pages")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_backfill_adds_what_has_no_row_yet(spark, tables):
    wanted = []
    for task in ("src0", "src1"):
        mine = [h for h in plain_hits("ring") if h[0] == task]
        there = [h for h in mine if h[1] % 5 or h[2] % 2 == 0]
        wanted += [(*h, i) for i, h in enumerate(there + [h for h in mine if h not in there], 1)]
    assert any(k % 5 == 0 and n % 2 for _, k, n, _, _ in wanted)
    got = QUERIES["l_backfill_occurrences"](spark, tables).select("task_id", "doc_id", "line_no", "start", "global_sequence")
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_every_page_has_its_nearest_line(spark, tables):
    wanted = []
    for k, p in {(k, n // 5) for k, n, _ in plain_lines()}:
        px, py, near = float(k % 300), float(k * 7 % 200), []
        for _, n, t in (x for x in plain_lines() if x[0] == k and x[1] // 5 == p):
            x0, y0, x1, y1 = plain_box(k, n, t)
            near.append((max(0.0, x0 - px, px - x1) ** 2 + max(0.0, y0 - py, py - y1) ** 2, n))
        dist, n = min(near)
        wanted.append((k, n, dist == 0, dist))
    assert len(wanted) == 3 * len(TEXTS)
    assert sorted(map(tuple, QUERIES["e_nearest_line"](spark, tables).select("id", "line_no", "contains", "dist").collect())) == sorted(wanted)


def plain_context(lined, line_no, mode, override):
    """(status, reason, orientation, block, previous, next, candidates) of a target, by the rules one after the other."""
    box = {n: b for n, _, b in lined}
    text = {n: t for n, t, _ in lined}
    mid = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    tall = lambda b: b[3] - b[1] >= b[2] - b[0]
    far = lambda b: math.dist(mid(b), mid(box[line_no]))
    upright = tall(box[line_no]) if mode == "auto" else mode == "vertical"
    some = [n for n in box if mode != "auto" or tall(box[n]) == upright]
    if len(some) > 256:
        some = [line_no] + sorted((n for n in some if n != line_no), key=lambda n: far(box[n]))[:255]
    along, across = ((0, 2), (1, 3)) if upright else ((1, 3), (0, 2))
    limit = 2.6 * max(1.0, statistics.median(box[n][along[1]] - box[n][along[0]] for n in some))

    def linked(p, q):
        shared = min(p[across[1]], q[across[1]]) - max(p[across[0]], q[across[0]])
        shorter = min(p[across[1]] - p[across[0]], q[across[1]] - q[across[0]])
        return max(0, shared) / shorter >= 0.28 and max(p[along[0]], q[along[0]]) - min(p[along[1]], q[along[1]]) <= limit

    groups, rest = [], list(some)
    while rest:
        todo = [rest.pop(0)]
        groups.append([])
        while todo:
            n = todo.pop()
            groups[-1].append(n)
            near = [m for m in rest if linked(box[n], box[m])]
            rest = [m for m in rest if m not in near]
            todo += near
    hull = lambda g: (min(box[n][0] for n in g), min(box[n][1] for n in g), max(box[n][2] for n in g), max(box[n][3] for n in g))
    ranked = sorted(groups, key=lambda g: (line_no not in g, far(hull(g))))[:64]
    own = ranked[0]
    if override:
        own = [n for n in some if n == line_no or (override[0] <= mid(box[n])[0] <= override[2] and override[1] <= mid(box[n])[1] <= override[3])]
    order = sorted(own, key=lambda n: (-mid(box[n])[0], mid(box[n])[1]) if upright else mid(box[n])[::-1])
    w, h = box[line_no][2] - box[line_no][0], box[line_no][3] - box[line_no][1]
    unsure = mode == "auto" and 0.45 + (max(w, h) / min(w, h) - 1) / 3 < 0.65
    reason = "orientation_uncertain" if unsure else "block_uncertain" if len(own) == 1 else None
    at = order.index(line_no)
    before, after = (None, None) if reason else (text[order[at - 1]] if at else None, text[order[at + 1]] if at + 1 < len(order) else None)
    return "uncertain" if reason else "ready", reason, "vertical" if upright else "horizontal", min(own), before, after, len(groups), [(len(g), line_no in g, *hull(g)) for g in ranked]


def test_contexts_against_plain_version(spark):
    r, lined, targets = random.Random(4), {}, []
    for page, n, side in ((1, 30, 500), (2, 8, 90), (3, 330, 2500), (4, 1, 50)):
        lined[page] = []
        for k in range(n):
            x, y, long, short = r.uniform(0, side), r.uniform(0, side), r.uniform(12, 90), r.uniform(8, 24)
            w, h = (short, long) if r.random() < 0.3 else (long, short)
            lined[page].append((k, f"line {k}", (x, y, x + w, y + h)))
        for k in range(0, n, 1 + n // 30):
            targets += [(page, k, mode, o) for mode, o in ((None, None), ("vertical", None), ("horizontal", None), ("auto", [0.0, 0.0, side / 2, side / 2]))]
    boxed = spark.createDataFrame([(7, p, n, t, *b) for p, some in lined.items() for n, t, b in some], "doc_id long, page_no int, line_no int, raw_text string, x0 double, y0 double, x1 double, y1 double")
    wanted = spark.createDataFrame([(7, p, k, i % 4, 5, mode, o) for i, (p, k, mode, o) in enumerate(targets)], "doc_id long, page_no int, line_no int, start int, end int, layout_mode string, block_override array<double>")
    got = {(c.page_no, c.line_no, c.start): c for c in L.layout_contexts(boxed, wanted).collect()}
    assert len(got) == len(targets)
    for i, (p, k, mode, o) in enumerate(targets):
        c = got[p, k, i % 4]
        assert (c.status, c.reason, c.orientation, c.block, c.previous, c.next, c.n_blocks, [(b.line_count, b.contains_target, *b.box) for b in c.candidate_blocks]) == plain_context(lined[p], k, mode or "auto", o)
        assert c.plain_text == "\n".join(x for x in (c.previous, f"line {k}", c.next) if x is not None) and [x.role for x in c.items].count("target") == 1
    assert {c.reason for c in got.values()} == {None, "orientation_uncertain", "block_uncertain"}


def test_merge_by_whole_keys_and_by_islands(spark, monkeypatch):
    import random

    from linequarry.operators import layout as L

    r = random.Random(11)
    box = lambda: ((x := float(r.randint(0, 200))), (y := float(r.choice([0, 3, 40]))), x + 6, y + 10)
    rows = [(f"g{k % 400}" if k % 2 else "big", k, r.choice(["pdf_ocr", "pdf_text_layer"]), *box()) for k in range(3000)] + [(None, 1, "pdf_ocr", 0.0, 0.0, 1.0, 1.0)]
    want = []
    for g in sorted({x[0] for x in rows if x[0]}):
        kept = []
        for row in (x for x in rows if x[0] == g):
            _plainly(row, kept)
        want += [(g, k["ordinal"], ",".join(sorted(k["sources"])), k["n"]) for k in kept]
    df = spark.createDataFrame(rows, "file string, ordinal long, source string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    for whole in (100, 0):
        assert sorted(tuple(x) for x in L.greedy_merge(df, ["file"], whole=whole).collect()) == sorted(want)
    # keys that a task can hold are not cut into islands across tasks
    monkeypatch.setattr(L, "_islands", None)
    assert sorted(tuple(x) for x in L.greedy_merge(df, ["file"]).collect()) == sorted(want)


def _plainly(row, kept):
    """One row against all representatives, without a grid."""
    _, ordinal, source, x0, y0, x1, y1 = row
    for rep in kept:
        apart = abs(rep["_mx"] - (x0 + x1) / 2) + abs(rep["_my"] - (y0 + y1) / 2)
        if apart <= 8 and (min(y1, rep["y1"]) - max(y0, rep["y0"])) / min(y1 - y0, rep["y1"] - rep["y0"]) >= 0.8:
            rep["sources"].add(source)
            rep["n"] += 1
            if source == "pdf_text_layer" != rep["source"]:
                rep.update(ordinal=ordinal, source=source, _mx=(x0 + x1) / 2, _my=(y0 + y1) / 2, y0=y0, y1=y1)
            return
    kept.append({"ordinal": ordinal, "source": source, "_mx": (x0 + x1) / 2, "_my": (y0 + y1) / 2, "y0": y0, "y1": y1, "sources": {source}, "n": 1})

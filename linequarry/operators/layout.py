"""Page layout around a match: line blocks by spatial neighbourhood, the nearest line, and the context of a target.

Blocks are connected components of a page's lines, found by a sweep in numpy over sorted partitions; neighbours, hulls
and candidates are windows and aggregates over lines and blocks. Only pages that have a target are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.geometry import gap
from ..sources.corpus import PAGE_HEIGHT, PAGE_WIDTH
from .numbering import _changes, written

#: neighbours' least overlap, largest gap in medians, most lines looked at, most candidate blocks.
OVERLAP, GAP_MEDIANS, MOST_LINES, MOST_BLOCKS = 0.28, 2.6, 256, 64
#: Orientations, the confidence below which one is unsure, the most an unsure and a sure context can have.
MODES, SURE, UNSURE_MOST, SURE_MOST = ("auto", "horizontal", "vertical"), 0.65, 0.55, 0.95
#: Classes of keys whose rows are counted before a merge, rows of a class up to which its keys go whole to a task.
CLASSES, WHOLE = 65_536, 200_000


def median_cross_size(boxed: DataFrame) -> DataFrame:
    """Per page the median of the lines' shorter sides (mean of the middle two)."""
    return boxed.groupBy("doc_id", "page_no").agg(F.median(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("median"))


def nearest_line(boxed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target point (id, doc_id, page_no, px, py) the line that contains it, else the nearest; ties by line order. An id may have a target on each of its pages."""
    both = targets.join(boxed, ["doc_id", "page_no"])
    dx, dy = gap(F.col("x0"), F.col("x1"), F.col("px"), F.col("px")), gap(F.col("y0"), F.col("y1"), F.col("py"), F.col("py"))
    both = both.withColumns({"dist": dx * dx + dy * dy})
    w = Window.partitionBy("doc_id", "page_no", "id").orderBy("dist", "line_index")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("id", "line_no", (F.col("dist") == 0).alias("contains"), "dist")


def nearest_k(boxed: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k lines of the page nearest to each target line by number."""
    both = targets.join(boxed.select("doc_id", "line_no"), "doc_id")
    far = F.abs(F.col("line_no") - F.col("target"))
    w = Window.partitionBy("doc_id", "target").orderBy(far, "line_no")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def close_pairs(low: np.ndarray, high: np.ndarray, apart: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of intervals that are no further apart than that, in the order of their beginnings, one neighbour at a time."""
    order = np.argsort(low, kind="stable")
    start, reach = low[order], high[order] + apart
    i = np.arange(len(order))
    for k in range(1, len(order)):
        i = i[i < len(order) - k]
        i = i[start[i + k] <= reach[i]]  # beginnings ascend: who doesn't reach the k-th next reaches none after it
        if not len(i):
            return
        yield order[i], order[i + k]


def _many(low: np.ndarray, high: np.ndarray, apart: float) -> int:
    """How many pairs close_pairs gives."""
    start = np.sort(low)
    return int((np.searchsorted(start, np.sort(high + apart), side="right")).sum()) - len(low) * (len(low) + 1) // 2


def _joined(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of each one's component."""
    label = np.arange(n)

    def up(x: np.ndarray) -> np.ndarray:
        while ((y := label[x]) != x).any():
            x = y
        return x

    for a, b in links:
        while True:
            x, y = up(a), up(b)
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    return up(label)


def blocks(boxes: np.ndarray, vertical: bool, least: float = 1.0) -> np.ndarray:
    """Block number (smallest line number) of each line: lines that overlap across the reading direction and lie close along it.

    least: the median size counts as this at least. A sweep looks at pairs that are close along, or that overlap across,
    whichever are fewer; equal boxes are one. Memory is linear in the lines.
    """
    if not len(boxes):
        return np.zeros(0, np.int64)
    some, first, back = np.unique(boxes, axis=0, return_index=True, return_inverse=True)
    x0, y0, x1, y1 = some.T
    across, along = ((y0, y1), (x0, x1)) if vertical else ((x0, x1), (y0, y1))
    side = boxes[:, 2] - boxes[:, 0] if vertical else boxes[:, 3] - boxes[:, 1]
    limit = GAP_MEDIANS * max(float(np.median(side)), least)

    def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by_along = _many(*along, limit) <= _many(*across, 0.0)
        for i, j in close_pairs(*along, limit) if by_along else close_pairs(*across, 0.0):
            shared = np.maximum(np.minimum(across[1][i], across[1][j]) - np.maximum(across[0][i], across[0][j]), 0)
            shorter = np.maximum(np.minimum(across[1][i] - across[0][i], across[1][j] - across[0][j]), 1e-9)
            apart = np.maximum(np.maximum(along[0][i], along[0][j]) - np.minimum(along[1][i], along[1][j]), 0)
            yes = (shared >= OVERLAP * shorter) & (apart <= limit)
            yield i[yes], j[yes]

    root = _joined(len(some), linked())[back.reshape(-1)]
    lowest = np.full(len(some), len(boxes))
    np.minimum.at(lowest, root, np.arange(len(boxes)))
    return lowest[root]


def page_blocks(boxed: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, block (least line_no of the block) for every line."""

    rows = boxed.select("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1")
    return rows.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "line_no").mapInArrow(_pages, "doc_id long, page_no int, line_no int, block int")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages that come one after the other; a page cut by the end of a batch waits for the rest."""
    rest: pa.Table | None = None

    def done(rows: pa.Table) -> pa.RecordBatch:
        doc, page, line = (rows.column(c).to_numpy() for c in ("doc_id", "page_no", "line_no"))
        box = np.stack([rows.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
        tall = (box[:, 3] - box[:, 1]) >= (box[:, 2] - box[:, 0])
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])))
        out = np.empty(len(doc), np.int32)
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)]):
            out[i:j] = line[i:j][blocks(box[i:j], bool(tall[i:j].sum() * 2 > j - i))]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(page), pa.array(line), pa.array(out)], ["doc_id", "page_no", "line_no", "block"])

    for b in batches:
        rows = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not rows.num_rows:
            continue
        doc, page = rows.column("doc_id").to_numpy(), rows.column("page_no").to_numpy()
        last = int(np.flatnonzero((doc == doc[-1]) & (page == page[-1]))[0])
        if last:
            yield done(rows.slice(0, last).combine_chunks())
        rest = rows.slice(last)
    if rest is not None and rest.num_rows:
        yield done(rest.combine_chunks())


_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_SIDES = ("x0", "y0", "x1", "y1")
_PAGE = ["doc_id", "page_no"]
_TARGET = [*_PAGE, "line_no", "start", "end", "mode", "override"]
_SCENE = [*_PAGE, "scene"]


def _scenes(lined: DataFrame, goals: DataFrame) -> DataFrame:
    """The lines that a target may stand among, each with its block: _SCENE, upright, place, line_no, raw_text, box, middle, block.

    A page has up to four scenes that all its targets share, by mode and orientation. Where more than MOST_LINES lines
    would take part, the target has a scene of its own: itself and the nearest others.
    """
    fits = (F.col("any_way")) | (F.col("is_upright") == F.col("upright"))
    shared = goals.where("shared").select(*_SCENE, "any_way", "upright").distinct().join(lined, _PAGE).where(fits).withColumn("place", F.col("line_no").cast("long"))
    own = goals.where("NOT shared").select(*_SCENE, "any_way", "upright", F.col("line_no").alias("goal"), F.col("mx").alias("gx"), F.col("my").alias("gy")).distinct().join(lined, _PAGE).where(fits)
    near = Window.partitionBy(*_SCENE).orderBy((F.col("line_no") == F.col("goal")).desc(), F.hypot(F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")), "line_no")
    own = own.withColumn("place", F.row_number().over(near).cast("long")).where(F.col("place") <= MOST_LINES)
    columns = [*_SCENE, "upright", "place", "line_no", "raw_text", *_SIDES, "mx", "my"]
    rows = shared.select(*columns).unionByName(own.select(*columns))
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    return rows.repartition(*_SCENE).sortWithinPartitions(*_SCENE, "place").mapInArrow(_by_scene, f"{kinds}, block long")


def _by_scene(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds block (the least place in it) to the lines of scenes that come one after the other."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        box = np.stack([rows.column(c).to_numpy() for c in _SIDES], axis=1)
        place = rows.column("place").to_numpy()
        label = blocks(box, bool(rows.column("upright")[0].as_py()))
        return pa.RecordBatch.from_arrays([*rows.combine_chunks().to_batches()[0].columns, pa.array(place[label])], [*rows.column_names, "block"])

    held: list[pa.Table] = []
    for b in batches:
        rows = pa.Table.from_batches([b])
        if not rows.num_rows:
            continue
        key = list(zip(*(rows.column(c).to_pylist() for c in _SCENE)))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        if held and tuple(held[0].column(c)[0].as_py() for c in _SCENE) != key[0]:
            yield done(pa.concat_tables(held))
            held = []
        for i, j in zip(cuts, cuts[1:]):
            if i:
                yield done(pa.concat_tables(held))
                held = []
            held.append(rows.slice(i, j - i))
    if held:
        yield done(pa.concat_tables(held))


def layout_contexts(boxed: DataFrame, targets: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    """Context of each target (doc_id, page_no, line_no, start, end): the lines before and after it in its block, in spatial order, and the page's blocks.

    targets may have layout_mode (auto where null) and block_override (x0, y0, x1, y1; none where null). In mode auto
    only lines of the target's orientation count. A target is uncertain, and then stands alone, if its orientation is
    unsure or no other line is in its block. Of a page's lines the MOST_LINES nearest are looked at, of its blocks the
    MOST_BLOCKS that rank first are listed: the target's own, then by distance; n_blocks counts all. Lines without text
    or with an empty or non-finite box take no part; a target on such a line, with another mode or with a range outside
    its line is an error. Targets that repeat are answered each for itself.
    """
    c, boxes_of = F.col, lambda some: F.struct(*[some[k].alias(n) for k, n in enumerate(_SIDES)])
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    given = lambda name, other: F.coalesce(c(name), other) if name in targets.columns else other
    rect = c("block_override").cast("array<double>") if "block_override" in targets.columns else F.lit(None).cast("array<double>")
    lined = boxed.select(c("doc_id").cast("long").alias("doc_id"), c("page_no").cast("int").alias("page_no"), c("line_no").cast("int").alias("line_no"), "raw_text", *_SIDES)
    sound = (F.length("raw_text") > 0) & (c("x1") > c("x0")) & (c("y1") > c("y0"))
    for n in _SIDES:
        sound = sound & finite(c(n))
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    ratio = F.when(h >= w, h / F.greatest(w, F.lit(1.0))).otherwise(w / F.greatest(h, F.lit(1.0)))
    lined = lined.where(sound).withColumns({"mx": (c("x0") + c("x1")) / 2, "my": (c("y0") + c("y1")) / 2, "is_upright": h >= w, "sure": F.least(F.lit(1.0), 0.45 + (ratio - 1.0) / 3.0)})

    asked = targets.select(c("doc_id").cast("long").alias("doc_id"), c("page_no").cast("int").alias("page_no"), c("line_no").cast("int").alias("line_no"), c("start").cast("int").alias("start"), c("end").cast("int").alias("end"), given("layout_mode", F.lit("auto")).alias("mode"), F.coalesce(rect, F.array().cast("array<double>")).alias("override"))
    asked = asked.groupBy(*_TARGET).agg(F.count("*").alias("copies"))
    # pages, goals and scenes are read several times below: each is worked out once
    pages = written(lined.join(asked.select(*_PAGE).distinct(), _PAGE, "left_semi"), "layout-pages")
    counts = pages.groupBy(*_PAGE).agg(F.count_if("is_upright").alias("n_upright"), F.count_if(~c("is_upright")).alias("n_flat"))
    wrong = F.when(~c("mode").isin(*MODES), F.raise_error(F.lit("layout_mode must be auto, horizontal or vertical"))).when(c("raw_text").isNull() | ~F.coalesce((c("start") >= 0) & (c("start") < c("end")) & (c("end") <= F.length("raw_text")), F.lit(False)), F.raise_error(F.lit("a target needs a line with a box and a range inside its text")))
    goals = asked.join(pages, [*_PAGE, "line_no"], "left").join(counts, _PAGE, "left")
    goals = goals.withColumn("any_way", F.when(wrong.isNull(), c("mode") != "auto"))
    goals = goals.withColumns({"upright": F.when(c("any_way"), c("mode") == "vertical").otherwise(c("is_upright")), "sure": F.when(c("any_way"), 1.0).otherwise(c("sure"))})
    fitting = F.when(c("any_way"), c("n_upright") + c("n_flat")).when(c("upright"), c("n_upright")).otherwise(c("n_flat"))
    goals = goals.withColumn("shared", fitting <= MOST_LINES)
    goals = goals.withColumn("scene", F.concat_ws(" ", c("any_way").cast("string"), c("upright").cast("string"), F.when(~c("shared"), c("line_no").cast("string"))))

    goals = written(goals, "layout-goals")
    scenes = written(_scenes(pages, goals), "layout-scenes")
    before_in_block = [F.when(c("upright"), -c("mx")).otherwise(c("my")), F.when(c("upright"), c("my")).otherwise(c("mx")), c("place")]
    line = F.struct("line_no", "raw_text", *_SIDES)
    hull = lambda over=None: F.struct(*[(f(n) if over is None else f(n).over(over)).alias(n) for n, f in zip(_SIDES, (F.min, F.min, F.max, F.max))])

    def around(rows: DataFrame, scope: list[str]) -> DataFrame:
        """The neighbours of every line among the lines of its scope, and what the scope holds."""
        whole, ordered = Window.partitionBy(*scope), Window.partitionBy(*scope).orderBy(*before_in_block)
        return rows.withColumns({"before": F.lag(line).over(ordered), "after": F.lead(line).over(ordered), "n_own": F.count("*").over(whole), "own_box": hull(whole), "lowest": F.min("line_no").over(whole)})

    found = ["before", "after", "n_own", "own_box", "lowest"]
    placed = goals.join(around(scenes, [*_SCENE, "block"]).select(*_SCENE, "line_no", "block", *found), [*_SCENE, "line_no"])
    o, any_rect = c("override"), "block_override" in targets.columns
    chosen = (F.size(o) == 4) & F.forall(o, finite) & (F.get(o, 2) > F.get(o, 0)) & (F.get(o, 3) > F.get(o, 1))
    placed = placed.withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    inside = c("mx").between(F.get("rect", 0), F.get("rect", 2)) & c("my").between(F.get("rect", 1), F.get("rect", 3))
    asked_for = placed.where("chosen" if any_rect else "false").select(*_SCENE, *[c(n).alias(f"_{n}") for n in _TARGET], o.alias("rect"), c("line_no").alias("goal"))
    in_rect = scenes.join(asked_for, _SCENE).where((c("line_no") == c("goal")) | inside)
    in_rect = around(in_rect, [f"_{n}" for n in _TARGET]).where("line_no = goal").select(*[c(f"_{n}").alias(n) for n in _TARGET], *found)
    rest = [n for n in placed.columns if n not in (*found, *_TARGET)]
    by_block = placed.where("NOT chosen").select(*_TARGET, *rest, *found) if any_rect else placed
    placed = by_block.unionByName(placed.where("chosen").drop(*found).join(in_rect, _TARGET).select(*_TARGET, *rest, *found)) if any_rect else placed.select(*_TARGET, *rest, *found)

    whole = scenes.groupBy(*_SCENE, "block").agg(F.count("*").cast("int").alias("n"), hull().alias("hull"))
    whole = whole.withColumn("k", F.row_number().over(Window.partitionBy(*_SCENE).orderBy("block")))  # a scene's blocks: MOST_LINES at most, or a page's
    listed = placed.select(*_TARGET, "scene", c("block").alias("own"), "mx", "my").join(whole, _SCENE)
    far = F.hypot((c("hull.x0") + c("hull.x1")) / 2 - c("mx"), (c("hull.y0") + c("hull.y1")) / 2 - c("my"))
    entry = F.struct((c("block") != c("own")).alias("other"), far.alias("far"), "k", "n", "hull")
    ranked = listed.groupBy(*_TARGET).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, MOST_BLOCKS).alias("blocks"), F.count("*").cast("int").alias("n_blocks"))

    size = {"x0": width, "x1": width, "y0": height, "y1": height}
    share = lambda box: F.struct(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), box[n] / max(1.0, size[n]))).alias(n) for n in _SIDES])
    plain = lambda box: F.struct(*[box[n].alias(n) for n in _SIDES])
    joined = placed.join(ranked, _TARGET)
    reason = F.when((c("mode") == "auto") & (c("sure") < SURE), "orientation_uncertain").when(c("n_own") == 1, "block_uncertain")
    joined = joined.withColumn("reason", reason).withColumns({n: F.when(c("reason").isNull(), c(n)) for n in ("before", "after")})
    item = lambda x, role: F.struct(x["line_no"].alias("line_no"), F.lit(role).alias("role"), x["raw_text"].alias("text"), plain(x).alias("box"), share(x).alias("normalised_box"))
    joined = joined.withColumn("goal_line", line)
    items = F.array_compact(F.array(F.when(c("before").isNotNull(), item(c("before"), "context")), item(c("goal_line"), "target"), F.when(c("after").isNotNull(), item(c("after"), "context"))))
    joined = joined.withColumn("items", items)
    over = F.struct(*[f(c(f"items.box.{n}")).alias(n) for n, f in zip(_SIDES, (F.array_min, F.array_min, F.array_max, F.array_max))])
    joined = joined.withColumn("box", over)
    candidates = F.transform("blocks", lambda b: F.struct(F.concat(F.lit("block-"), b["k"].cast("string")).alias("id"), b["n"].alias("line_count"), (~b["other"]).alias("contains_target"), b["hull"].alias("box"), share(b["hull"]).alias("normalised_box")))
    out = joined.select(
        *_PAGE, "line_no", "start", "end", F.when(c("reason").isNull(), "ready").otherwise("uncertain").alias("status"), "reason", F.when(c("upright"), "vertical").otherwise("horizontal").alias("orientation"),
        F.round(F.least("sure", F.when(c("reason").isNull(), SURE_MOST).otherwise(UNSURE_MOST)), 4).alias("confidence"), c("lowest").alias("block"), c("before.raw_text").alias("previous"), c("after.raw_text").alias("next"),
        F.array_join(F.transform("items", lambda i: i["text"]), "\n").alias("plain_text"), "box", share(c("box")).alias("normalised_box"), c("own_box").alias("block_box"), share(c("own_box")).alias("normalised_block_box"), "items", "n_blocks",
        candidates.alias("candidate_blocks"), F.explode(F.sequence(F.lit(1).cast("long"), c("copies"))).alias("_copy"),
    )
    return out.drop("_copy")


def _islands(rows: DataFrame, scope: list[str], value: str, gap: float, name: str) -> DataFrame:
    """Adds name: a number per scope that changes where the value leaps by more than gap, so that what lies that far apart is told apart.

    Ranges of (scope, value) are gone through apart; a row per scope and range says how many islands lie before it and
    whether its first goes on with the last one before.
    """
    columns = [*rows.columns, name]
    key = [*scope, value]
    names = [*rows.columns, "_range", "_island"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, at, island = TaskContext.get().partitionId(), None, 0.0, 0
        for b in batches:
            out = []
            for k, v in zip(zip(*(b.column(c).to_pylist() for c in scope)), b.column(value).to_pylist()):
                island = 0 if k != last else island + (v - at > gap)
                last, at = k, v
                out.append(island)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([here] * len(out), pa.int32()), pa.array(out, pa.int64())], names)

    schema = ", ".join([f"`{n}` {k}" for n, k in rows.dtypes] + ["_range int", "_island long"])
    cut = written(rows.repartitionByRange(*key, F.monotonically_increasing_id()).sortWithinPartitions(*key).mapInArrow(run, schema), "islands")
    ranges = cut.groupBy(*scope, "_range").agg((F.max("_island") + 1).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    w = Window.partitionBy(*scope).orderBy("_range")
    goes_on = F.coalesce((F.col("_low") - F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= gap).cast("long"), F.lit(0))
    ranges = ranges.withColumn("_on", goes_on)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("_on").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.select(*scope, "_range", before.alias("_before"))
    return cut.join(ranges, [*scope, "_range"]).withColumn(name, F.col("_before") + F.col("_island")).select(*columns)


def greedy_merge(found: DataFrame, keys: list[str], near: float = 8.0, overlap: float = 0.8, whole: int = WHOLE) -> DataFrame:
    """Near-duplicate occurrences merged one after the other into the first representative that fits; order matters.

    found: keys, ordinal, source, x0, y0, x1, y1. A text-layer row replaces a representative that is not one. Returns
    the representatives with the sorted union of their sources. Null keys, ordinals or boxes take no part.

    Rows whose middles lie further apart than near never meet. Keys go whole to a task, which cuts them into islands by
    x and then by y, decides islands of one or two rows all at once and goes through the others in order. Classes of
    keys with more than `whole` rows are cut into islands across tasks first.
    """
    kinds = ", ".join(f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys) + ", ordinal long, sources string, n long"
    used = found.select(*keys, "ordinal", "source", *_SIDES).dropna()
    used = written(used.withColumn("_class", F.pmod(F.xxhash64(*keys), F.lit(CLASSES)).cast("int")), "merge-rows")
    large = [r._class for r in used.groupBy("_class").agg(F.count("*").alias("_n")).where(F.col("_n") > whole).select("_class").collect()]  # CLASSES at most
    few = used.where(~F.col("_class").isin(large)) if large else used
    out = few.drop("_class").repartition(*keys).sortWithinPartitions(*keys, "ordinal").mapInArrow(_whole_keys(keys, kinds, near, overlap), kinds)
    return out.unionAll(_by_islands(used.where(F.col("_class").isin(large)).drop("_class"), keys, kinds, near, overlap)) if large else out


def _by_islands(used: DataFrame, keys: list[str], kinds: str, near: float, overlap: float) -> DataFrame:
    """greedy_merge for keys that no task can hold: an island is gone through in order by one task, which holds its
    representatives in a grid and looks only at the cells around a row. Text layers only ever move a representative to
    the box of another row of its island."""
    used = used.withColumns({"_mx": (F.col("x0") + F.col("x1")) / 2, "_my": (F.col("y0") + F.col("y1")) / 2})
    island = _islands(_islands(used, keys, "_mx", near, "_ix"), [*keys, "_ix"], "_my", near, "_iy")
    scope = [*keys, "_ix", "_iy"]
    target = to_arrow_schema(_parse_datatype_string(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, kept = None, {}, []

        def out() -> pa.RecordBatch:
            rows = [dict(zip(keys, now)) | {"ordinal": r["ordinal"], "sources": ",".join(sorted(r["sources"])), "n": r["n"]} for r in kept]
            return pa.RecordBatch.from_pylist(rows, target)

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in scope)
                if key != now:
                    if kept:
                        yield out()
                    now, grid, kept = key, {}, []
                _merge(row, grid, kept, near, overlap)
        if kept:
            yield out()

    return island.repartition(*scope).sortWithinPartitions(*scope, "ordinal").mapInArrow(run, kinds)


def _apart(group: np.ndarray, value: np.ndarray, gap: float) -> np.ndarray:
    """Numbers that tell apart groups, and within one what lies more than gap apart."""
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    with np.errstate(invalid="ignore"):
        leap = (g[1:] != g[:-1]) | (v[1:] - v[:-1] > gap)
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(leap)
    return out


def _whole_keys(keys: list[str], kinds: str, near: float, overlap: float):
    """Merges keys that come one after the other, each in order; a key cut by the end of a batch waits for the rest."""
    target = to_arrow_schema(_parse_datatype_string(kinds))

    def changes(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for k in keys:
            new[1:] |= _changes(rows.column(k))
        return new

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x0, y0, x1, y1 = (rows.column(c).to_numpy() for c in _SIDES)
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        island = _apart(_apart(np.cumsum(changes(rows)), mx, near), my, near)
        order = np.argsort(island, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(island[order]) != 0))
        size = np.diff(np.append(begin, len(order)))
        source = rows.column("source").to_pylist()
        layer = np.asarray(pc.ends_with(rows.column("source"), "text_layer"))
        a, b = order[begin[size == 2]], order[begin[size == 2] + 1]
        with np.errstate(invalid="ignore"):
            shared = np.maximum(np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b]), 0.0)
            shorter = np.maximum(np.minimum(y1[a] - y0[a], y1[b] - y0[b]), 1e-9)
            fits = (np.abs(mx[a] - mx[b]) + np.abs(my[a] - my[b]) <= near) & (shared / shorter >= overlap)
        both = np.where(layer[b] & ~layer[a], b, a)[fits]
        place = [*order[begin[size == 1]].tolist(), *a[~fits].tolist(), *b[~fits].tolist()]
        sources, n = [source[k] for k in place], [1] * len(place)
        place += both.tolist()
        sources += [source[i] if source[i] == source[j] else ",".join(sorted((source[i], source[j]))) for i, j in zip(a[fits].tolist(), b[fits].tolist())]
        n += [2] * len(both)
        for at, many in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            grid, kept = {}, []
            for j in order[at : at + many].tolist():
                _merge({"ordinal": j, "source": source[j], "_mx": float(mx[j]), "_my": float(my[j]), "x0": x0[j], "y0": float(y0[j]), "x1": x1[j], "y1": float(y1[j])}, grid, kept, near, overlap)
            place += [r["ordinal"] for r in kept]
            sources += [",".join(sorted(r["sources"])) for r in kept]
            n += [r["n"] for r in kept]
        at = pa.array(place, pa.int64())
        return pa.RecordBatch.from_arrays([*[rows.column(k).take(at) for k in keys], rows.column("ordinal").take(at).cast(pa.int64()), pa.array(sources, pa.string()), pa.array(n, pa.int64())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = changes(b)
            new[0] = bool(held) and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys)
            last = int(np.flatnonzero(new)[-1]) if new.any() else None
            if last is not None:
                yield done([*held, b.slice(0, last)])
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield done(held)

    return run


def _merge(row: dict, grid: dict, kept: list[dict], near: float, overlap: float) -> None:
    """Put one row to the first representative that fits, or among them; grid: cell of near by near, its representatives' places."""
    cell = lambda r: (math.floor(r["_mx"] / near), math.floor(r["_my"] / near))
    x, y = cell(row)
    for k in sorted(k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((x + dx, y + dy), ())):
        rep = kept[k]
        shared = max(0.0, min(rep["y1"], row["y1"]) - max(rep["y0"], row["y0"]))
        shorter = max(min(rep["y1"] - rep["y0"], row["y1"] - row["y0"]), 1e-9)
        if abs(rep["_mx"] - row["_mx"]) + abs(rep["_my"] - row["_my"]) <= near and shared / shorter >= overlap:
            rep["sources"].add(row["source"])
            rep["n"] += 1
            if row["source"].endswith("text_layer") and not rep["source"].endswith("text_layer"):
                grid[cell(rep)].discard(k)
                rep.update({c: row[c] for c in ("ordinal", "source", "_mx", "_my", *_SIDES)})
                grid.setdefault((x, y), set()).add(k)
            return
    grid.setdefault((x, y), set()).add(len(kept))
    kept.append(row | {"sources": {row["source"]}, "n": 1})

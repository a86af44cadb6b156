"""Rows as callers and exports see them: decoded lines, stored occurrences, names, contexts without recognised lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_hash, clamped, part_of_box
from ..functions.text import base_name, code_points

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: The version of stored contexts that is read.
CONTEXT_VERSION = 2
#: States of a task and their labels; what an unknown one is called.
STATUS_LABELS = {
    "draft": "Not started", "queued": "Queued", "starting": "Starting", "running": "Scanning", "pausing": "Pausing", "paused": "Paused", "resuming": "Resuming", "stopping": "Cancelling",
    "recoverable": "Recoverable", "stale": "Stale", "completed": "Completed", "failed": "Failed", "cancelled": "Cancelled",
}
#: Least and most per cent of the three panes.
PANES = {"image": (30.0, 68.0), "list": (18.0, 40.0), "detail": (18.0, 42.0)}


def decoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON columns as nested values; what cannot be read is null. kinds: column -> type."""
    return rows.select(*[(F.from_json(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c)) for c in rows.columns])


#: The nested columns of a stored line, without the `_json` that their stored names end in. Boxes are four corners.
LINE_KINDS = {
    "bbox": "array<array<double>>",
    "word_boxes": "array<array<array<double>>>",
    "word_text": "array<string>",
    "word_confidences": "array<double>",
    "isolated_top_k": "array<struct<text:string,confidence:double>>",
    "script_reconciliations": "array<struct<index:int,source:string,resolved:string>>",
    "correction_provenance": "struct<method:string,confidence:double>",
}


def decoded_lines(rows: DataFrame, kinds: dict[str, str] = LINE_KINDS) -> DataFrame:
    """Adds to stored lines (columns named *_json) the nested values under the plain names. Null and empty text is null.

    Text that is no JSON of that kind is null too, and `undecodable` lists the columns where that is so: one bad line
    does not end a read of all of them. Each text is parsed once.
    """
    stored = {c: F.nullif(F.nullif(F.col(f"{c}_json"), F.lit("")), F.lit("null")) for c in kinds}
    # a single object reads as a list of one, and as null where it is broken
    values = {c: F.get(F.from_json(t, f"array<{kinds[c]}>"), F.lit(0)) if kinds[c].startswith("struct") else F.from_json(t, kinds[c]) for c, t in stored.items()}
    bad = F.array_compact(F.array(*[F.when(t.isNotNull() & F.col(c).isNull(), F.lit(c)) for c, t in stored.items()]))
    return rows.withColumns(values).withColumn("undecodable", bad)


def session_hits(hits: DataFrame, lined: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits of a session with their line, the path of its source and the place of the match on the page, in shares.

    hits: task_id, doc_id, line_no, start, end, layer_priority; lined: doc_id, line_no, source_id, page_no, line_index,
    raw_text, x0, y0, x1, y1, page_width, page_height; sources: task_id, source_id, display_path. A hit without line
    does not appear, a source without path goes by its id. Without a page size or a box a hit takes the whole page.
    """
    both = hits.join(lined, ["doc_id", "line_no"]).join(sources, ["task_id", "source_id"], "left")
    part = part_of_box(F.length("raw_text"), F.col("start"), F.col("end"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    sized = (F.col("page_width") > 0) & (F.col("page_height") > 0) & F.col("x0").isNotNull() & (F.length("raw_text") > 0)
    share = lambda value, side, other: F.when(sized, clamped(value / F.nullif(F.col(side), F.lit(0.0)))).otherwise(F.lit(other))
    return both.withColumns(
        {
            "display_path": F.coalesce("display_path", "source_id"),
            "normalized_x0": share(part["mx0"], "page_width", 0.0),
            "normalized_y0": share(part["my0"], "page_height", 0.0),
            "normalized_x1": share(part["mx1"], "page_width", 1.0),
            "normalized_y1": share(part["my1"], "page_height", 1.0),
        }
    )


#: The order of a session's hits; nulls come first.
SESSION_ORDER = ["layer_priority", "source_id", "page_no", "line_index", "start", "doc_id", "line_no"]


def with_context(rows: DataFrame, kind: str = "status string, orientation string, plain_text string") -> DataFrame:
    """layout_context read from its JSON, only where it was stored in the current version."""
    return rows.withColumn("layout_context", F.when(F.col("layout_context_version") == CONTEXT_VERSION, F.from_json("layout_context_json", kind)))


def relative_to(path: Column, root: Column) -> Column:
    """A path below root, with forward slashes; empty if there is none or it lies elsewhere."""
    flat, top = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(flat, top), F.substring(flat, F.length(top) + 1, F.length(flat))).otherwise("")


def stored_rows(found: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """Occurrences as they are stored: paths below the workspace, the page's size, and the box's digest where it is missing."""
    digest = F.when(F.coalesce("bbox_hash", F.lit("")) != "", F.col("bbox_hash")).otherwise(box_hash(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    both = found.join(pages.select("source_id", "page_no", "image_path", "page_width", "page_height"), ["source_id", "page_no"], "left")
    below = lambda c: relative_to(F.coalesce(F.col(c), F.lit("")), F.lit(root))
    return both.withColumns({"bbox_hash": digest, "page_image_relpath": below("image_path"), "crop_image_relpath": below("crop_path")}).drop("image_path", "crop_path")


def recovered(found: DataFrame) -> DataFrame:
    """Occurrences read back with their defaults, and why one is refused (null if it is not)."""
    text = F.coalesce(F.nullif(F.col("matched_text"), F.lit("")), F.nullif(F.col("matched_character"), F.lit("")))
    refused = F.when(text.isNull(), "matched_text is required").when(F.coalesce("bbox_hash", F.lit("")) == "", "bbox_hash is required")
    return found.withColumns({"matched_text": text, "matched_character": F.coalesce("matched_character", F.when(F.length(text) == 1, text)), "unicode_sequence": F.coalesce("unicode_sequence", code_points(text)), "refused": refused})


def single_hit(hits: DataFrame, pages: DataFrame, task_id: str, hit_id: int) -> DataFrame:
    """One hit with its page, if the page is known; the filter comes before the join."""
    return hits.where((F.col("task_id") == task_id) & (F.col("hit_id") == hit_id)).join(pages, ["doc_id", "page_no"], "left")


def source_paths(sources: DataFrame) -> DataFrame:
    """A path for every source (source_order, path, file_name), each used once: its own where that is given and nobody
    before has it, else a numbered folder, and from the second of equal ones on a suffix."""
    taken = F.row_number().over(Window.partitionBy("path").orderBy("source_order"))
    own = sources.withColumn("_own", F.when((F.coalesce("path", F.lit("")) != "") & (taken == 1), F.col("path")))
    again = F.row_number().over(Window.partitionBy("_own", "source_order", "file_name").orderBy("path"))
    folder = F.concat(F.lit("source-"), F.format_string("%03d", F.col("source_order") + 1), F.when(again > 1, F.concat(F.lit("-"), again)).otherwise(""))
    return own.withColumn("relative_path", F.coalesce("_own", F.concat_ws("/", folder, "file_name"))).drop("_own")


def task_names(tasks: DataFrame) -> DataFrame:
    """display_name of tasks (name, source_dir, search_text): an own name, else source and search text, else what there is."""
    source = base_name(F.regexp_replace(F.coalesce("source_dir", F.lit("")), r"[\\/]+$", ""))
    raw, said = F.trim(F.coalesce("name", F.lit(""))), F.coalesce("search_text", F.lit(""))
    built = F.concat(F.when(source == "", "Local archive").otherwise(source), F.lit(" · search “"), said, F.lit("”"))
    shown = F.when((raw != "") & (raw != source), raw).when(said != "", built).when(raw != "", raw).when(source != "", source).otherwise("Scan task")
    return tasks.withColumn("display_name", shown)


def status_view(status: Column, failures: Column) -> Column:
    """(label, tone) of a task's state; a completed one with failures is only partly so."""
    known = F.create_map(*[F.lit(x) for p in STATUS_LABELS.items() for x in p])
    label = F.coalesce(F.try_element_at(known, status), F.nullif(status, F.lit("")), F.lit("Unknown"))
    tone = F.when(status == "completed", "PASS").when(status.isin("failed", "cancelled", "stale"), "FAIL").otherwise("WARN")
    part = (status == "completed") & (failures > 0)
    return F.struct(F.when(part, F.concat(F.lit("Partly completed ("), failures, F.lit(" failed)"))).otherwise(label).alias("label"), F.when(part, "WARN").otherwise(tone).alias("tone"))


def fallback_context(rows: DataFrame) -> DataFrame:
    """Context of targets on pages without recognised lines: the stored box, else the one in shares of the page, else a band.

    rows: matched_text, layout_mode, width, height, x0..y1, nx0..ny1. Always uncertain, for want of evidence.
    """
    num = lambda c, other=0.0: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(other))
    sides = ("x0", "y0", "x1", "y1")
    size = {"x": num("width", 1.0), "y": num("height", 1.0)}
    n = {c: num("n" + c) for c in sides}
    own = (num("x1") > num("x0")) & (num("y1") > num("y0"))
    shares = (n["x0"] >= 0) & (n["x0"] < n["x1"]) & (n["x1"] <= 1) & (n["y0"] >= 0) & (n["y0"] < n["y1"]) & (n["y1"] <= 1)
    out = rows.withColumns({f"_b{c}": F.when(own | ~shares, num(c)).otherwise(n[c] * size[c[0]]) for c in sides})
    b = {c: F.col(f"_b{c}") for c in sides}
    tall = F.when(F.col("layout_mode") == "auto", b["y1"] - b["y0"] >= b["x1"] - b["x0"]).otherwise(F.col("layout_mode") == "vertical")
    out = out.withColumns({"_tall": tall, **{f"_n{c}": clamped(b[c] / F.greatest(size[c[0]], F.lit(1.0))) for c in sides}})
    empty = (F.col("_nx1") <= F.col("_nx0")) | (F.col("_ny1") <= F.col("_ny0"))
    band = {c: F.when(F.col("_tall"), F.lit(v)).otherwise(F.lit(h)) for c, v, h in (("x0", 0.45, 0.1), ("y0", 0.1, 0.45), ("x1", 0.55, 0.9), ("y1", 0.9, 0.55))}
    share = {c: F.when(empty, band[c]).otherwise(F.col(f"_n{c}")) for c in sides}
    box = {c: F.when(empty, band[c] * size[c[0]]).otherwise(b[c]) for c in sides}
    text = F.coalesce("matched_text", F.lit(""))
    made = {
        "status": F.lit("uncertain"), "reason": F.lit("ocr_evidence_missing"), "orientation": F.when(F.col("_tall"), "vertical").otherwise("horizontal"), "confidence": F.lit(0.0), "plain_text": text, "match_start": F.lit(0), "match_end": F.length(text),
        "box": F.struct(*[box[c].alias(c) for c in sides]).cast(_BOX), "normalised_box": F.struct(*[share[c].alias(c) for c in sides]).cast(_BOX),
    }
    return out.withColumns(made).drop("_tall", *[f"_b{c}" for c in sides], *[f"_n{c}" for c in sides])


def block_box(nx0: Column, ny0: Column, nx1: Column, ny1: Column, width: Column, height: Column) -> Column:
    """A box given in shares of the page, on the page; null if it is not inside, empty, or the page has no size."""
    fine = F.lit(True)
    for c in (nx0, ny0, nx1, ny1):
        fine = fine & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    fine = fine & (nx1 > nx0) & (ny1 > ny0) & (F.coalesce(width, F.lit(0.0)) > 0) & (F.coalesce(height, F.lit(0.0)) > 0)
    return F.when(fine, F.struct((nx0 * width).alias("x0"), (ny0 * height).alias("y0"), (nx1 * width).alias("x1"), (ny1 * height).alias("y1")))


def pane_ratios(image: Column, listed: Column, detail: Column) -> dict[str, Column]:
    """Shares of three panes inside their limits that add up to 100; what is missing or too much goes by the room left."""
    held = {k: F.greatest(F.lit(low), F.least(F.lit(high), c)) for (k, (low, high)), c in zip(PANES.items(), (image, listed, detail))}
    off = F.lit(100.0) - (held["image"] + held["list"] + held["detail"])
    room = {k: F.when(off > 0, F.lit(PANES[k][1]) - v).otherwise(v - F.lit(PANES[k][0])) for k, v in held.items()}
    total = room["image"] + room["list"] + room["detail"]
    return {k: F.when(F.abs(off) < 1e-12, v).otherwise(v + off * room[k] / total) for k, v in held.items()}


def spatial_context(hits: DataFrame, boxed: DataFrame, direction: str = "ltr", radius: int = 15) -> DataFrame:
    """Hits (doc_id, page_no, line_no, start, end) with up to radius visible characters before and after, over line ends.

    A page's lines follow one another in the reading direction, parted by line ends; white space does not count. A
    line whose characters stand against the direction is read backwards.
    """
    if direction not in ("ltr", "rtl", "ttb", "btt"):
        raise ValueError("direction must be ltr, rtl, ttb or btt")
    if isinstance(radius, bool) or not isinstance(radius, int) or not 1 <= radius <= 50:
        raise ValueError("radius must be a whole number from 1 to 50")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    first, second = {"ltr": (cy, cx), "rtl": (cy, -cx), "ttb": (-cx, cy), "btt": (cx, -cy)}[direction]
    upright = (F.col("y1") - F.col("y0")) >= (F.col("x1") - F.col("x0"))
    turned = {"ltr": F.lit(False), "rtl": ~upright, "ttb": ~upright, "btt": upright}[direction]
    read = F.when(turned, F.reverse("raw_text")).otherwise(F.col("raw_text"))
    pages = boxed.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(first.alias("a"), second.alias("b"), "line_no", read.alias("t"), turned.alias("turned")))).alias("lines"))
    both = hits.select("doc_id", "page_no", "line_no", "start", "end").join(pages, ["doc_id", "page_no"])
    both = both.withColumn("_at", F.array_position(F.transform("lines", lambda x: x["line_no"]), F.col("line_no")).cast("int"))
    own = F.element_at("lines", F.col("_at"))
    n = F.length(own["t"])
    low, high = F.when(own["turned"], n - F.col("end")).otherwise(F.col("start")), F.when(own["turned"], n - F.col("start")).otherwise(F.col("end"))
    text = lambda some: F.transform(some, lambda x: x["t"])
    ahead = F.array_join(F.concat(text(F.slice("lines", 1, F.col("_at") - 1)), F.array(F.substring(own["t"], F.lit(1), low))), "\n")
    later = F.array_join(F.concat(F.array(F.substring(own["t"], high + 1, n)), text(F.slice("lines", F.col("_at") + 1, F.size("lines")))), "\n")
    seen = rf"(?:\S\s*){{0,{radius}}}"
    return both.select("doc_id", "line_no", "start", F.regexp_replace(F.regexp_extract(ahead, f"({seen})$", 1), r"^\s+|\s+$", "").alias("before"), F.regexp_replace(F.regexp_extract(later, rf"^(\s*{seen})", 1), r"^\s+|\s+$", "").alias("after"))

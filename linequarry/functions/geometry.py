"""Boxes and intervals as column expressions. A box is (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Box in shares of the page; a page of size 0 is an error, as division is."""
    return {"nx0": x0 / width, "ny0": y0 / height, "nx1": x1 / width, "ny1": y1 / height}


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def box_hash(*sides: Column) -> Column:
    """Digest of a box; sides are rounded before they are written, so equal boxes have equal digests."""
    return F.sha1(F.concat_ws("|", *[F.format_string("%.8f", F.round(s, 8)) for s in sides]))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter interval's, 0 where that has none."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals, 0 where they meet."""
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def centre_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Sum of the centres' distances along both axes."""
    return F.abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) + F.abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def orientation(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(orientation, confidence): at least as tall as wide is vertical."""
    w, h = x1 - x0, y1 - y0
    ratio = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-6))
    return F.when(h >= w, "vertical").otherwise("horizontal"), F.least(F.lit(1.0), 0.45 + (ratio - 1.0) / 3.0)


def part_of_box(n: Column, start: Column, end: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """Union of the boxes of characters start to end (exclusive) when a line's box is cut evenly along its length."""
    tall = (y1 - y0) >= (x1 - x0)
    along = lambda a, b, k: a + (b - a) * k / n
    return {"mx0": F.when(tall, x0).otherwise(along(x0, x1, start)), "my0": F.when(tall, along(y0, y1, start)).otherwise(y0), "mx1": F.when(tall, x1).otherwise(along(x0, x1, end)), "my1": F.when(tall, along(y0, y1, end)).otherwise(y1)}


def match_box(word_boxes: Column, line_box: Column, start: Column, end: Column) -> Column:
    """Smallest box around the word boxes of a span, the line's box where the span or the boxes don't fit; boxes are structs of x0, y0, x1, y1."""
    fits = (start >= 0) & (start < end) & (end <= F.size(word_boxes))
    some = F.filter(F.slice(word_boxes, F.when(fits, start + 1).otherwise(F.lit(1)), F.when(fits, end - start).otherwise(F.lit(0))), lambda b: b.isNotNull())
    side = lambda pick, k: pick(F.transform(some, lambda b: b[k]))
    whole = F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"))
    return F.when(F.coalesce(fits, F.lit(False)) & (F.size(some) > 0), whole).otherwise(line_box)


def polygon_box(polygon: Column) -> Column:
    """Smallest box around a polygon (array of [x, y]), null unless finite and of positive size."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    fine = ~F.exists(F.concat(xs, ys), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(fine & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def rotated(polygon: Column, width: Column) -> Column:
    """A polygon read on the page turned by a quarter, back on the page."""
    return F.transform(polygon, lambda p: F.array(width - p[1], p[0]))


def crop(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, padding: int = 12) -> dict[str, Column]:
    """Whole-pixel bounds with padding inside the page; halves go to the even number."""
    low = lambda v: F.greatest(F.lit(0), F.bround(v - padding).cast("int"))
    high = lambda v, m: F.least(m.cast("int"), F.bround(v + padding).cast("int"))
    return {"cx0": low(x0), "cy0": low(y0), "cx1": high(x1, width), "cy1": high(y1, height)}


def dpi(width_px: Column, height_px: Column, css_width: Column, css_height: Column) -> Column:
    """Resolution at which a page reaches the asked size."""
    return F.ceil(F.greatest(width_px / css_width, height_px / css_height) * 96)

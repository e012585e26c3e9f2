"""Boxes as structs of doubles; arithmetic on columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def valid(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def from_xywh(x: Column, y: Column, w: Column, h: Column, least: float = 1e-3) -> Column:
    return box(x, y, x + F.greatest(w, F.lit(least)), y + F.greatest(h, F.lit(least)))


def from_quad(xs: Column, ys: Column, least: float = 1e-3) -> Column:
    """Envelope of the corners."""
    x1, y1 = F.array_min(xs), F.array_min(ys)
    return box(x1, y1, F.greatest(F.array_max(xs), x1 + least), F.greatest(F.array_max(ys), y1 + least))


def intersects(a: Column, b: Column) -> Column:
    """Touching edges do not intersect."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    total = area(a) + area(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def center_distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def rotated_bounds(b: Column, degrees: Column, w: Column, h: Column) -> Column:
    """The box after its page turned about its middle and grew to hold all of it, clamped to the new page."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    nw, nh = F.floor(h * s + w * c), F.floor(h * c + w * s)
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    xs, ys = [], []
    for x in ("x1", "x2"):
        for y in ("y1", "y2"):
            dx, dy = b[x] - w / 2, b[y] - h / 2
            xs.append(cos * dx + sin * dy + nw / 2)
            ys.append(cos * dy - sin * dx + nh / 2)
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return box(clamp(F.least(*xs), nw), clamp(F.least(*ys), nh), clamp(F.greatest(*xs), nw), clamp(F.greatest(*ys), nh))


def normalized(b: Column, w: Column, h: Column) -> Column:
    """Shares of the page, clipped to it and rounded to six places."""
    unit = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)
    return box(unit(b["x1"] / w), unit(b["y1"] / h), unit(b["x2"] / w), unit(b["y2"] / h))


def to_pixels(b: Column, w: Column, h: Column) -> Column:
    return F.struct(
        F.floor(b["x1"] * w).alias("x1"), F.floor(b["y1"] * h).alias("y1"), F.ceil(b["x2"] * w).alias("x2"), F.ceil(b["y2"] * h).alias("y2")
    )


def padded(b: Column, w: Column, h: Column) -> Column:
    """Grown by three pixels or a quarter of a percent of the longer side, within the page."""
    pad = F.greatest(F.lit(3.0), F.greatest(w, h) * 0.0025)
    zero = F.lit(0.0)
    return box(F.greatest(zero, b["x1"] - pad), F.greatest(zero, b["y1"] - pad), F.least(w, b["x2"] + pad), F.least(h, b["y2"] + pad))


def confidence(raw: Column) -> Column:
    """0 to 1 from either scale; null is 0."""
    v = F.coalesce(raw.cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v)))


def tiles(w: Column, h: Column, size: int, overlap: float) -> Column:
    """Array of overlapping tiles (row, col, x, y, width, height) over a page."""
    step = max(1, round(size * (1 - overlap)))
    starts = lambda n: F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda v: (v == 0) | (v - step + size < n))
    grid = F.flatten(
        F.transform(
            starts(h),
            lambda y: F.transform(
                starts(w),
                lambda x: F.struct(
                    (y / step).cast("int").alias("row"), (x / step).cast("int").alias("col"), x.alias("x"), y.alias("y"), F.least(F.lit(size), w - x).alias("width"), F.least(F.lit(size), h - y).alias("height")
                ),
            ),
        )
    )
    zero = F.lit(0)
    whole = F.array(F.struct(zero.alias("row"), zero.alias("col"), zero.alias("x"), zero.alias("y"), w.alias("width"), h.alias("height")))
    return F.when((h <= size) & (w <= size), whole).otherwise(grid)


def should_tile(w: Column, h: Column, size: int, least_side: int, enabled: bool = True) -> Column:
    return F.lit(enabled) & ((F.least(w, h) >= least_side) | (F.greatest(w, h) > size))


def long_edge(w: Column, h: Column, most: int) -> Column:
    """Width and height of a page whose longer edge is at most so long; 0 is no limit."""
    scale = most / F.greatest(w, h).cast("double")
    sized = lambda n: F.greatest(F.lit(1), F.bround(n * scale).cast("int"))
    shrinks = (F.lit(most) > 0) & (F.greatest(w, h) > most)
    return F.struct(F.when(shrinks, sized(w)).otherwise(w).alias("width"), F.when(shrinks, sized(h)).otherwise(h).alias("height"))


def on_page(b: Column, tile: Column) -> Column:
    """A box of a tile in the coordinates of its page."""
    return shifted(b, tile["x"], tile["y"])


def remapped(b: Column, page: Column, original: Column, degrees: Column, processed: Column, least: float = 1e-3) -> Column:
    """A box of a recognised page on the processed one; page, original and processed are sizes (width, height).

    It is scaled to the original, turned with it where the angle is a twentieth of a degree or
    more, scaled to the processed page, enclosed and clamped.
    """
    w, h = original["width"].cast("double"), original["height"].cast("double")
    sx, sy = w / page["width"], h / page["height"]
    turns = F.abs(degrees) >= 0.05
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    new_w = F.when(turns, F.bround(h * F.abs(sin) + w * F.abs(cos))).otherwise(w)
    new_h = F.when(turns, F.bround(h * F.abs(cos) + w * F.abs(sin))).otherwise(h)
    fx, fy = processed["width"] / new_w, processed["height"] / new_h
    xs, ys = [], []
    for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")):
        dx, dy = b[x] * sx - w / 2, b[y] * sy - h / 2
        xs.append(F.when(turns, cos * dx + sin * dy + new_w / 2).otherwise(b[x] * sx) * fx)
        ys.append(F.when(turns, cos * dy - sin * dx + new_h / 2).otherwise(b[y] * sy) * fy)
    low = lambda values, size: F.greatest(F.lit(0.0), F.least(F.least(*values), size - least))
    x1, y1 = low(xs, processed["width"]), low(ys, processed["height"])
    return box(x1, y1, F.greatest(x1 + least, F.least(F.greatest(*xs), processed["width"])), F.greatest(y1 + least, F.least(F.greatest(*ys), processed["height"])))


def font_size(w: Column, h: Column) -> Column:
    return F.least(F.lit(28.0), F.greatest(F.lit(10.0), F.greatest(w, h) / 70.0))


def badge(index: Column, w: Column, h: Column) -> Column:
    """Width, height and gap, in pixels, of the badge with a number on a page of this size."""
    font = F.greatest(F.lit(10), F.bround(font_size(w, h)).cast("int"))
    across, down = F.greatest(F.lit(6), F.bround(font * 0.45).cast("int")), F.greatest(F.lit(4), F.bround(font * 0.30).cast("int"))
    text = F.greatest(font, F.ceil(font * 0.7 * F.char_length(index.cast("string"))).cast("int"))
    gap = F.greatest(F.lit(4), F.bround(font_size(w, h) * 0.45).cast("int"))
    return F.struct((text + 2 * across).alias("width"), (font + 2 * down).alias("height"), gap.alias("gap"))

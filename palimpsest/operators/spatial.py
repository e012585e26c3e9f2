"""Clusters of records on a page, annotation rows and badge places."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions import geometry


def neighbours(boxes: DataFrame, near: Callable[[Column, Column], Column], cell: float | None = None) -> DataFrame:
    """Pairs (page, a, b), a < b, of boxes (page, id, bbox) of one page that are near.

    With ``cell``, the farthest that near boxes' centers can lie apart, centers are binned into
    squares of that side and only squares that touch are compared.
    """
    if cell is None:
        left = boxes.select("page", F.col("id").alias("a"), F.col("bbox").alias("p"))
        right = boxes.select("page", F.col("id").alias("b"), F.col("bbox").alias("q"))
        return left.join(right, "page").filter((F.col("a") < F.col("b")) & near(F.col("p"), F.col("q"))).select("page", "a", "b")
    at = geometry.center(F.col("bbox"))
    gridded = boxes.withColumns({"gx": F.floor(at["x"] / cell), "gy": F.floor(at["y"] / cell)})
    around = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = gridded.select("page", F.col("id").alias("a"), F.col("bbox").alias("p"), F.explode(around).alias("g")).select("page", "a", "p", "g.gx", "g.gy")
    right = gridded.select("page", F.col("id").alias("b"), F.col("bbox").alias("q"), "gx", "gy")
    return left.join(right, ["page", "gx", "gy"]).filter((F.col("a") < F.col("b")) & near(F.col("p"), F.col("q"))).select("page", "a", "b")


def by_distance(boxes: DataFrame, most: float) -> DataFrame:
    return neighbours(boxes, lambda p, q: geometry.center_distance(p, q) <= most, most if most > 0 else None)


def by_overlap(boxes: DataFrame, least: float) -> DataFrame:
    """With a least overlap of 0 all boxes of a page are near each other."""
    return neighbours(boxes, lambda p, q: geometry.iou(p, q) >= least)


def clusters(boxes: DataFrame, edges: DataFrame, *, cut) -> DataFrame:
    """Least id reachable (``cluster``) of every box, by pulling labels along edges and then along labels."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    state = cut(boxes.select("id", F.col("id").alias("cluster")))
    while True:
        pulled = both.join(state.select(F.col("id").alias("v"), "cluster"), "v").groupBy(F.col("u").alias("id")).agg(F.min("cluster").alias("least"))
        met = state.join(pulled, "id", "left").select("id", "cluster", F.least("cluster", F.coalesce("least", "cluster")).alias("new"))
        jump = met.select(F.col("id").alias("new"), F.col("new").alias("further"))
        moved = cut(met.join(jump, "new").select("id", F.least("new", "further").alias("cluster"), (F.least("new", "further") < F.col("cluster")).alias("moved")))
        state = moved.select("id", "cluster")
        if moved.filter("moved").isEmpty():
            return state


def annotations(results: DataFrame) -> DataFrame:
    """Visible results numbered from 1 within a comparison, anchored on the source box where there is one."""
    visible = results.filter(F.col("match_type").isin("changed_value", "missing_in_target", "extra_in_target", "uncertain"))
    n = F.row_number().over(W.partitionBy("pair_id").orderBy("result_ord"))
    return visible.withColumn("index", n).withColumn("annotation_id", F.format_string("ann-%03d", n)).withColumn("anchor", F.coalesce("s_bbox", "t_bbox"))


_PLACED = "pair_id {0}, page_number int, index int, placement string, x1 int, y1 int, x2 int, y2 int"
Rectangle = tuple[int, int, int, int]


def _apart(a: Rectangle, others: list[Rectangle], pad: int) -> bool:
    return all(a[2] + pad <= b[0] or b[2] + pad <= a[0] or a[3] + pad <= b[1] or b[3] + pad <= a[1] for b in others)


def _slid(x: int, y: int, w: int, h: int, page: tuple[int, int], along: int, gap: int, taken: list[Rectangle], avoid: list[Rectangle]) -> Rectangle | None:
    """The place nearest to (x, y) along an axis (0 across, 1 down) that is free, by whole steps forth and back."""
    step, size = max(4, gap, min(w, h) // 3), (w, h)[along]
    room = max(0, page[along] - size)
    for k in range(room // step + 2):
        for shift in (k * step, -k * step)[: 2 if k else 1]:
            at = (x, y)[along] + shift
            if not 0 <= at <= page[along] - size:
                continue
            own = (at, y, at + w, y + h) if along == 0 else (x, at, x + w, at + h)
            if _apart(own, taken, max(2, gap // 2)) and _apart(own, avoid, max(1, gap // 3)):
                return own
    return None


def place_badge(mark: Rectangle, w: int, h: int, gap: int, page: tuple[int, int], taken: list[Rectangle], marks: list[Rectangle]) -> tuple[str, Rectangle]:
    """Beside its mark, above, right, left or below, where the page has room and no badge or mark is in the way; else inside it."""
    x1, y1, x2, y2 = mark
    most_x, most_y = max(0, page[0] - w), max(0, page[1] - h)
    sides = [
        ("outside_top", y1 >= h + gap, min(x1, most_x), y1 - h - gap, 0),
        ("outside_right", x2 + gap + w <= page[0], x2 + gap, min(y1, most_y), 1),
        ("outside_left", x1 >= w + gap, x1 - w - gap, min(y1, most_y), 1),
        ("outside_bottom", y2 + gap + h <= page[1], min(x1, most_x), y2 + gap, 0),
    ]
    for name, fits, x, y, along in sides:
        if fits and (own := _slid(x, y, w, h, page, along, gap, taken, marks)):
            return name, own
    x = min(max(x1 + gap, 0), min(most_x, max(x1, x2 - w)))
    y = min(max(y1 + gap, 0), min(most_y, max(y1, y2 - h)))
    return "inside", _slid(x, y, w, h, page, 0, max(2, gap // 2), taken, []) or (x, y, x + w, y + h)


def badge_places(marks: DataFrame, width: int, height: int) -> DataFrame:
    """Places of numbered badges (pair_id, page_number, index, anchor), one after the other on each page of this size.

    A page is one task's, since each badge gives way to those before it.
    """
    kind = marks.schema["pair_id"].dataType.simpleString()

    def place(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("index")
        boxes = [tuple(map(int, r)) for r in rows[["x1", "y1", "x2", "y2"]].to_numpy().tolist()]
        taken, found = [], []
        for box, w, h, gap in zip(boxes, rows.badge_width.tolist(), rows.badge_height.tolist(), rows.gap.tolist()):
            name, own = place_badge(box, w, h, gap, (width, height), taken, boxes)
            taken.append(own)
            found.append((name, *own))
        made = pd.DataFrame(found, columns=["placement", "x1", "y1", "x2", "y2"])
        return pd.concat([rows[["pair_id", "page_number", "index"]].reset_index(drop=True), made], axis=1)

    size = geometry.badge(F.col("index"), F.lit(width), F.lit(height))
    pixels = [F.floor("anchor.x1").alias("x1"), F.floor("anchor.y1").alias("y1"), F.ceil("anchor.x2").alias("x2"), F.ceil("anchor.y2").alias("y2")]
    flat = marks.select("pair_id", "page_number", "index", *pixels, size["width"].alias("badge_width"), size["height"].alias("badge_height"), size["gap"].alias("gap"))
    return flat.groupBy("pair_id", "page_number").applyInPandas(place, _PLACED.format(kind))

"""Drawing: rectangles, gradients, lines, curves and polygons onto pixel rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, color, columns, over, over_pm
from .point import put

Point = tuple[float, float]


def _painted(mode: str, c: Sequence[int]):
    paint = color(*c)
    if mode == "copy" or c[3] == 255:
        return paint
    if mode == "transparent":
        return paint if c[3] else columns()
    if mode == "alpha":
        return over(paint, columns(), opaque=True)
    if mode == "alpha_pm":
        return over_pm(paint, columns(), opaque=True)
    return paint


def paint_where(df: DataFrame, hit: Column, c: Sequence[int], mode: str = "copy") -> DataFrame:
    """Colour `c` (r, g, b, a) where `hit`; blended results are opaque."""
    out = _painted(mode, c)
    return put(df, {k: F.when(hit, out[k]).otherwise(F.col(k)) for k in CHANNELS})


def _inside(x: int, y: int, w: int, h: int) -> Column:
    return F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)


def fill_rect(df: DataFrame, rect: tuple[int, int, int, int], c: Sequence[int], mode: str = "copy") -> DataFrame:
    return paint_where(df, _inside(*rect), c, mode)


def draw_rect(df: DataFrame, rect: tuple[int, int, int, int], c: Sequence[int], thickness: int = 1, mode: str = "copy") -> DataFrame:
    """A frame inside the rectangle; solid once its sides meet."""
    x, y, w, h = rect
    t = thickness
    if 2 * t >= min(w, h):
        return fill_rect(df, rect, c, mode)
    return paint_where(df, _inside(x, y, w, h) & ~_inside(x + t, y + t, w - 2 * t, h - 2 * t), c, mode)


def fill_gradient_rect(df: DataFrame, rect: tuple[int, int, int, int], tl: Sequence[int], tr: Sequence[int], bl: Sequence[int], br: Sequence[int], mode: str = "copy") -> DataFrame:
    """Four corner colours, interpolated in 16.16 down the sides and then along the row."""
    x, y, w, h = rect
    sx, sy = 65_536 // (w - 1) if w > 1 else 0, 65_536 // (h - 1) if h > 1 else 0
    fx, fy = (F.col("x") - x) * sx, (F.col("y") - y) * sy
    out = {}
    for i, k in enumerate(CHANNELS):
        left = F.shiftright(F.lit(tl[i]) * (65_536 - fy) + F.lit(bl[i]) * fy + 32_768, 16)
        right = F.shiftright(F.lit(tr[i]) * (65_536 - fy) + F.lit(br[i]) * fy + 32_768, 16)
        out[k] = F.shiftright(left * (65_536 - fx) + right * fx + 32_768, 16)
    if mode == "alpha":
        out = over(out, columns(), opaque=True)
    elif mode == "alpha_pm":
        out = over_pm(out, columns(), opaque=True)
    elif mode == "transparent":
        out = {k: F.when(out["a"] != 0, v).otherwise(F.col(k)) for k, v in out.items()}
    hit = _inside(*rect)
    return put(df, {k: F.when(hit, out[k]).otherwise(F.col(k)) for k in CHANNELS})


def line_points(x1: int, y1: int, x2: int, y2: int) -> tuple[str, Column]:
    """(driving axis, the other coordinate as a function of it) of a Bresenham line.

    The error term is linear, so step i along the driving axis has moved floor((2*i*minor + major) /
    (2*major)) across; no pixel list is needed and clipping costs nothing.
    """
    dx, dy = x2 - x1, y2 - y1
    steep = abs(dy) > abs(dx)
    major, minor = (abs(dy), abs(dx)) if steep else (abs(dx), abs(dy))
    along, start, to = ("y", y1, 1 if dy >= 0 else -1) if steep else ("x", x1, 1 if dx >= 0 else -1)
    across, side = (x1, 1 if dx >= 0 else -1) if steep else (y1, 1 if dy >= 0 else -1)
    i = (F.col(along) - start) * to
    moved = F.floor((2 * i * minor + major) / (2 * major)).cast("int") if major else F.lit(0)
    return along, F.lit(across) + moved * side


def on_line(x1: int, y1: int, x2: int, y2: int, skip_start: bool = False) -> Column:
    along, other = line_points(x1, y1, x2, y2)
    a, b = (y1, y2) if along == "y" else (x1, x2)
    hit = F.col(along).between(min(a, b), max(a, b)) & (F.col("x" if along == "y" else "y") == other)
    return hit & ~((F.col("x") == x1) & (F.col("y") == y1)) if skip_start else hit


def draw_line(df: DataFrame, p1: tuple[int, int], p2: tuple[int, int], c: Sequence[int], mode: str = "copy", skip_start: bool = False) -> DataFrame:
    return paint_where(df, on_line(*p1, *p2, skip_start), c, mode)


def polygon_spans(points: Sequence[Point], height: int) -> list[tuple[int, int, int]]:
    """(y, first x, last x) of the even-odd fill: crossings at y + 0.5, paired from left to right."""
    spans = []
    for y in range(max(0, math.floor(min(p[1] for p in points))), min(height, math.ceil(max(p[1] for p in points)) + 1)):
        at = y + 0.5
        xs = sorted(a[0] + (at - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(points, [*points[1:], points[0]], strict=True) if (a[1] <= at) != (b[1] <= at))
        spans += [(y, int(math.floor(a + 0.5)), int(math.floor(b + 0.5))) for a, b in zip(xs[::2], xs[1::2], strict=False)]
    return spans


def inside_polygon(points: Sequence[Point]) -> Column:
    """Whether a pixel lies between an odd and the following even crossing of its scan line.

    For every edge a crossing is an expression of y; a pixel is inside if an odd number of crossings,
    rounded, lies at or before it (and it is not past its pair's end). The plan has one term for each edge.
    """
    at = F.col("y") + 0.5
    crossings = []
    for a, b in zip(points, [*points[1:], points[0]], strict=True):
        if a[1] == b[1]:
            continue
        low, high = min(a[1], b[1]), max(a[1], b[1])
        x = F.lit(float(a[0])) + (at - float(a[1])) * (float(b[0]) - float(a[0])) / (float(b[1]) - float(a[1]))
        crossings.append(F.when((at >= low) & (at < high), F.floor(x + 0.5).cast("int")))
    if not crossings:
        return F.lit(False)
    xs = F.array_sort(F.array_compact(F.array(*crossings)))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: (F.col("x") >= F.get(xs, 2 * i)) & (F.col("x") <= F.get(xs, 2 * i + 1)))
    return F.when(F.size(xs) >= 2, F.exists(pairs, lambda p: F.coalesce(p, F.lit(False)))).otherwise(False)


def fill_polygon(df: DataFrame, points: Sequence[Point], c: Sequence[int], mode: str = "copy") -> DataFrame:
    """Even-odd fill of one polygon with few edges on every image."""
    return paint_where(df, inside_polygon(points), c, mode)


def fill_polygons(df: DataFrame, vertices: DataFrame, c: Sequence[int]) -> DataFrame:
    """Fill polygons given as a relation (image_id, poly_id, seq, x, y): edges meet scan lines, crossings are
    ranked in pairs, and pixels join their line's spans, which are few: an equi-join on the line, then an interval test."""
    w = Window.partitionBy("image_id", "poly_id").orderBy("seq")
    first = Window.partitionBy("image_id", "poly_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.withColumns({"x2": F.coalesce(F.lead("x").over(w), F.first("x").over(first)), "y2": F.coalesce(F.lead("y").over(w), F.first("y").over(first))}).where("y <> y2")
    lo, hi = F.ceil(F.least("y", "y2") - 0.5).cast("int"), (F.ceil(F.greatest("y", "y2") - 0.5) - 1).cast("int")
    lines = edges.where(lo <= hi).withColumn("line", F.explode(F.sequence(lo, hi)))
    cross = lines.withColumn("cx", F.floor(F.col("x") + (F.col("line") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y")) + 0.5).cast("int"))
    order = Window.partitionBy("image_id", "poly_id", "line").orderBy("cx")
    ranked = cross.withColumn("k", F.row_number().over(order)).withColumn("end", F.lead("cx").over(order)).where("k % 2 = 1 AND end IS NOT NULL")
    spans = ranked.groupBy("image_id", F.col("line").alias("y")).agg(F.collect_list(F.struct(F.col("cx").alias("from"), F.col("end").alias("to"))).alias("__spans"))  # a row for each painted line
    joined = df.join(spans, ["image_id", "y"], "left")
    return paint_where(joined, F.coalesce(F.exists("__spans", lambda s: F.col("x").between(s["from"], s["to"])), F.lit(False)), c).select(*df.columns)


def draw_thick_line(df: DataFrame, p1: Point, p2: Point, thickness: float, c: Sequence[int], mode: str = "copy") -> DataFrame:
    """A quadrilateral around the line between pixel centres."""
    (x1, y1), (x2, y2) = ((p[0] + 0.5, p[1] + 0.5) for p in (p1, p2))
    length = math.hypot(x2 - x1, y2 - y1) or 1.0
    nx, ny = -(y2 - y1) / length * thickness / 2, (x2 - x1) / length * thickness / 2
    return fill_polygon(df, [(x1 + nx, y1 + ny), (x2 + nx, y2 + ny), (x2 - nx, y2 - ny), (x1 - nx, y1 - ny)], c, mode)


def bezier_points(p1: Point, c1: Point, c2: Point, p2: Point, steps: int = 0) -> list[tuple[int, int]]:
    """Corners of the polyline; 0 steps means a quarter of the control polygon's length, 20 at least."""
    length = math.dist(p1, c1) + math.dist(c1, c2) + math.dist(c2, p2)
    steps = steps or max(int(length * 0.25), 20)
    out = []
    for i in range(steps + 1):
        t = i / steps
        w = ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
        out.append((int(sum(k * p[0] for k, p in zip(w, (p1, c1, c2, p2), strict=True)) + 0.5), int(sum(k * p[1] for k, p in zip(w, (p1, c1, c2, p2), strict=True)) + 0.5)))
    return out


def draw_bezier(df: DataFrame, p1: Point, c1: Point, c2: Point, p2: Point, c: Sequence[int], steps: int = 0, mode: str = "copy") -> DataFrame:
    """A cubic curve as lines that skip their first pixel, so that no pixel blends twice."""
    points = bezier_points(p1, c1, c2, p2, steps)
    hit = (F.col("x") == points[0][0]) & (F.col("y") == points[0][1])
    for a, b in zip(points, points[1:], strict=False):
        if a != b:
            hit = hit | on_line(*a, *b, skip_start=True)
    return paint_where(df, hit, c, mode)

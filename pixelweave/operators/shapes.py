"""Many shapes at once: rectangles, frames, gradients, lines, curves and polygons from a relation, painted in its order.

Every shape becomes the pixels that it covers, by sequences that are clipped to its image first. An opaque shape hides those below
it: the last one of each pixel is found by a maximum, whose partial results are all that is shuffled, and in a second pass what lies
below is dropped where it is made. A pixel then gathers the rest in one join and takes them in their order, each over what the ones before left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, over, over_pm
from ..functions.lineage import written
from .geometry import sizes_of

KINDS = ("rect", "frame", "gradient", "line", "curve", "polygon")
MODES = ("copy", "transparent", "alpha", "alpha_pm")
COLOR = "struct<r: int, g: int, b: int, a: int>"
#: The columns of a relation of shapes. rect, frame, gradient: points are (x, y), (width, height), colors the four corners for a gradient;
#: line: its ends; curve: start, two control points, end, and n steps (0: by length); polygon: its corners. thickness: of a frame.
SCHEMA = f"image_id long, ord long, kind string, points array<struct<x: double, y: double>>, n int, thickness int, skip_start boolean, mode string, colors array<{COLOR}>"


def _point(k: int, c: str) -> Column:
    return F.get("points", F.lit(k))[c]


def _whole(k: int, c: str) -> Column:
    return _point(k, c).cast("long")


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _cells(rects: DataFrame) -> DataFrame:
    """The pixels (x, y) of rows with rx, ry, rw, rh, inside their image."""
    lines = rects.withColumn("y", F.explode(_range(F.greatest("ry", F.lit(0)), F.least(F.col("ry") + F.col("rh"), F.col("height")) - 1)))
    return lines.withColumn("x", F.explode(_range(F.greatest("rx", F.lit(0)), F.least(F.col("rx") + F.col("rw"), F.col("width")) - 1))).drop("rx", "ry", "rw", "rh")


def _rectangles(shapes: DataFrame) -> DataFrame:
    """Rectangles as they are, frames as four strips, or whole where the strips meet. Gradients are made elsewhere: with their
    colours this would be one method too large to be compiled at run time."""
    x, y, w, h, t = _whole(0, "x"), _whole(0, "y"), _whole(1, "x"), _whole(1, "y"), F.coalesce("thickness", F.lit(1))
    strip = lambda *v: F.struct(*[e.cast("long").alias(n) for e, n in zip(v, ("rx", "ry", "rw", "rh"), strict=True)])
    strips = F.array(strip(x, y, w, t), strip(x, y + h - t, w, t), strip(x, y + t, t, h - 2 * t), strip(x + w - t, y + t, t, h - 2 * t))
    hollow = (F.col("kind") == "frame") & (2 * t < F.least(w, h))
    parts = F.when(hollow, strips).otherwise(F.array(strip(x, y, w, h)))
    cells = _cells(shapes.where(F.col("kind").isin("rect", "frame")).withColumn("part", F.explode(parts)).select("*", "part.*").drop("part"))
    return cells.withColumn("paint", F.get("colors", F.lit(0)))


def _gradients(shapes: DataFrame) -> DataFrame:
    """Rectangles between four corner colours."""
    x, y, w, h = _whole(0, "x"), _whole(0, "y"), _whole(1, "x"), _whole(1, "y")
    cells = _cells(shapes.where("kind = 'gradient'").withColumns({"rx": x, "ry": y, "rw": w, "rh": h}))
    step = lambda n: F.when(n > 1, F.floor(65_536 / (n - 1))).otherwise(0)
    fx, fy = (F.col("x") - x) * step(w), (F.col("y") - y) * step(h)
    mixed = lambda a, b, f: F.shiftright(a * (65_536 - f) + b * f + 32_768, 16)
    corner = lambda k, c: F.get("colors", F.lit(k))[c].cast("long")
    return cells.withColumn("paint", F.struct(*[mixed(mixed(corner(0, c), corner(2, c), fy), mixed(corner(1, c), corner(3, c), fy), fx).cast("int").alias(c) for c in CHANNELS]))


def _segments(lines: DataFrame) -> DataFrame:
    """The pixels of rows with x1, y1, x2, y2, skip_start: Bresenham lines, of which only the steps inside the image are written out."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    steep = F.abs(dy) > F.abs(dx)
    major, minor = F.greatest(F.abs(dx), F.abs(dy)), F.least(F.abs(dx), F.abs(dy))
    sign = lambda v: F.when(v >= 0, 1).otherwise(-1)
    start, to, size = F.when(steep, F.col("y1")).otherwise(F.col("x1")), F.when(steep, sign(dy)).otherwise(sign(dx)), F.when(steep, F.col("height")).otherwise(F.col("width"))
    low = F.greatest(F.when(F.col("skip_start"), 1).otherwise(0), F.when(to > 0, -start).otherwise(start - size + 1))
    high = F.least(major, F.when(to > 0, size - 1 - start).otherwise(start))
    # What a pixel needs is worked out for its line first: the code of each pixel has to stay small enough to be compiled at run time.
    # explode and a plain condition would have all of it worked out once more below, for filters against nulls and empty ranges; these are dropped here.
    pick = lambda a, b: F.when(steep, F.col(a)).otherwise(F.col(b))
    known = {"steep": steep, "start": start, "to": to, "major": major, "rise": 2 * minor, "run": F.greatest(2 * major, F.lit(1)), "aside": pick("x1", "y1"), "side": F.when(steep, sign(dx)).otherwise(sign(dy)), "room": pick("width", "height")}
    rows = lines.withColumns(known | {"low": low, "high": high}).withColumn("i", F.explode_outer(_range(F.col("low"), F.col("high"))))
    cells = rows.withColumn("across", F.expr("aside + side * ((i * rise + major) div run)")).where("coalesce(across >= 0 AND across < room, false)").withColumn("along", F.expr("start + i * to"))
    return cells.withColumns({"x": F.expr("if(steep, across, along)"), "y": F.expr("if(steep, along, across)"), "paint": F.get("colors", F.lit(0))})


def _lines(shapes: DataFrame) -> DataFrame:
    ends = {"x1": _whole(0, "x"), "y1": _whole(0, "y"), "x2": _whole(1, "x"), "y2": _whole(1, "y")}
    return _segments(shapes.where("kind = 'line'").withColumns(ends).withColumn("skip_start", F.coalesce("skip_start", F.lit(False))))


def _curves(shapes: DataFrame) -> DataFrame:
    """A cubic as lines between the rounded points of its steps; where they meet, a pixel comes more than once."""
    far = lambda a, b: F.sqrt(F.pow(_point(a, "x") - _point(b, "x"), F.lit(2)) + F.pow(_point(a, "y") - _point(b, "y"), F.lit(2)))
    steps = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).otherwise(F.greatest(((far(0, 1) + far(1, 2) + far(2, 3)) * 0.25).cast("int"), F.lit(20)))

    def at(i: Column, c: str) -> Column:
        t = i / F.col("n")
        u = 1 - t
        return (u * u * u * _point(0, c) + 3 * t * u * u * _point(1, c) + 3 * t * t * u * _point(2, c) + t * t * t * _point(3, c) + 0.5).cast("long")

    i = F.col("i")
    dots = shapes.where("kind = 'curve'").withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    ends = {c + k: at(v, c) for k, v in (("1", F.greatest(i - 1, F.lit(0))), ("2", i)) for c in "xy"}
    return _segments(dots.withColumns(ends).withColumn("skip_start", i > 0).drop("i"))


def _polygons(shapes: DataFrame) -> DataFrame:
    """Even-odd fill: edges meet scan lines half a pixel down, crossings are ranked in pairs; where spans touch, a pixel comes twice."""
    corners = shapes.where("kind = 'polygon'")
    edge = F.transform("points", lambda p, k: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("points", F.pmod(k + 1, F.size("points")))["x"].alias("x2"), F.get("points", F.pmod(k + 1, F.size("points")))["y"].alias("y2")))
    edges = corners.withColumn("edge", F.explode(edge)).select("*", "edge.*").drop("edge").where("y1 <> y2")
    low, high = F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1
    lines = edges.withColumn("y", F.explode(_range(F.greatest(low, F.lit(0)), F.least(high, F.col("height") - 1))))
    cross = lines.withColumn("cx", F.floor(F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) + 0.5))
    order = Window.partitionBy("image_id", "ord", "y").orderBy("cx")  # the crossings of one shape on one line
    spans = cross.withColumns({"k": F.row_number().over(order), "end": F.lead("cx").over(order)}).where("k % 2 = 1 AND end IS NOT NULL")
    cells = spans.withColumn("x", F.explode(_range(F.greatest("cx", F.lit(0)), F.least(F.col("end"), F.col("width") - 1))))
    return cells.withColumn("paint", F.get("colors", F.lit(0)))


def marks(shapes: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, ord, x, y, mode, paint, once): the pixels that each of `shapes` (SCHEMA) covers on `images` (image_id, width, height).
    A curve or polygon may have a pixel more than once, but paints it once: there `once` tells it from others of equal `ord`; else it is null."""
    once = F.when(F.col("kind").isin("curve", "polygon"), F.xxhash64("points", "n"))
    # A small file of shapes, which one task would read, has many pixels: it is dealt to a given number of tasks, since Spark would choose it by bytes.
    session = shapes.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    spread = shapes.repartition(tasks, "image_id", "ord", "points")
    known = spread.withColumn("once", once).join(images.select("image_id", "width", "height"), "image_id")
    out = ("image_id", "ord", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "mode", "paint", "once")
    return reduce(DataFrame.unionByName, [f(known).select(*out) for f in (_rectangles, _gradients, _lines, _curves, _polygons)])


def _over(under: Column, mark: Column) -> Column:
    """One mark over a pixel: opaque colours and mode copy replace it, blended results are opaque."""
    o, u, mode = {c: mark["paint"][c] for c in CHANNELS}, {c: under[c] for c in CHANNELS}, mark["mode"]
    straight, added = over(o, u, opaque=True), over_pm(o, u, opaque=True)
    whole = (mode == "copy") | (o["a"] == 255) | ~mode.isin(*MODES)
    pick = lambda c: F.when(whole, o[c]).when(mode == "transparent", F.when(o["a"] != 0, o[c]).otherwise(u[c])).when(mode == "alpha", straight[c]).otherwise(added[c])
    return F.struct(*[pick(c).cast("int").alias(c) for c in CHANNELS])


def paint(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """`df` with `shapes` (SCHEMA) painted in the order of `ord` in each image; other columns of `df` stay.

    Shapes are clipped to their image; those of unknown images, kinds or null points paint nothing, and unknown modes count as
    copy. A null mode is copy. Shapes of equal `ord` go by mode and colour. A pixel gathers its marks above the last
    opaque one only; the see-through marks of one pixel have to fit a row.
    """
    found = marks(shapes.where("points IS NOT NULL AND colors IS NOT NULL").withColumn("mode", F.coalesce("mode", F.lit("copy"))), written(sizes_of(df), "sizes")).where("paint IS NOT NULL")
    solid = (F.col("mode") == "copy") | (F.col("paint.a") == 255) | ~F.col("mode").isin(*MODES)
    pixel = ["image_id", "x", "y"]
    least = written(found.where(solid).groupBy(*pixel).agg(F.max("ord").alias("least")), "opaque")
    top = found.join(least, pixel, "left").where(F.col("least").isNull() | (F.col("ord") >= F.col("least")))
    mark = F.struct("ord", "mode", "paint", "once")
    gathered = F.concat(F.collect_list(F.when(F.col("once").isNull(), mark)), F.collect_set(F.when(F.col("once").isNotNull(), mark)))
    stacked = top.groupBy(*pixel).agg(F.sort_array(gathered).alias("__marks"))
    met = df.join(stacked, ["image_id", "x", "y"], "left")
    first = F.struct(*[F.col(c).cast("int").alias(c) for c in CHANNELS])
    painted = met.withColumn("__painted", F.when(F.col("__marks").isNotNull(), F.aggregate("__marks", first, _over)))
    return painted.select(*[F.coalesce(F.col("__painted")[c], F.col(c)).alias(c) if c in CHANNELS else F.col(c) for c in df.columns])

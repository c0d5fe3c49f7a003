"""Resizing, fitting, cropping, padding, flips and turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS

FIT_MODES = ("none", "stretch", "fit", "fill")


def grid(images: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, width, height, x, y) of a raster of that size for each image."""
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))) if height > 0 else images.where("false").withColumn("y", F.lit(0))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))) if width > 0 else rows.where("false").withColumn("x", F.lit(0))
    return cells.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "x", "y")


def resize(df: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest neighbour in 16.16 steps: destination i takes source (i * (size << 16) / new size) >> 16.

    Each source pixel is copied to the destinations that take it, so there is no join and no shuffle.
    Columns beside coordinates are carried. A size of 0 gives no pixels.
    """
    if width <= 0 or height <= 0:
        return df.where("false")
    return _resized(df, F.lit(width), F.lit(height))


def _resized(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Each pixel at the run of places that take it, which follows from two divisions."""

    def places(at: str, size: str, new: Column) -> Column:
        step = F.floor(F.col(size) * 65_536 / new).cast("long")
        first = lambda v: F.when(step > 0, F.floor((v * 65_536 + step - 1) / step)).otherwise(F.when(v > 0, new).otherwise(0))
        low, high = first(F.col(at)), F.least(first(F.col(at) + 1), new) - 1
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    out = df.withColumn("__x", F.explode(places("x", "width", width))).withColumn("__y", F.explode(places("y", "height", height)))
    return out.withColumns({"x": F.col("__x"), "y": F.col("__y"), "width": width.cast("int"), "height": height.cast("int")}).drop("__x", "__y")


def with_sizes(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels with new_width and new_height of their image, from `sizes` (image_id, new_width, new_height; an image
    once). Images without a row there, or with a size below 1 or null, are left out."""
    wanted = sizes.where("new_width > 0 AND new_height > 0").select("image_id", F.col("new_width").cast("int").alias("new_width"), F.col("new_height").cast("int").alias("new_height"))
    return df.join(wanted, "image_id")


def resize_each(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """`resize` of images of any sizes, each to its own size in `sizes` (image_id, new_width, new_height)."""
    sized = with_sizes(df, sizes)
    return _resized(sized, F.col("new_width"), F.col("new_height")).drop("new_width", "new_height")


def sizes_of(df: DataFrame) -> DataFrame:
    """(image_id, width, height): a row for each image."""
    return df.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def calculated_sizes(images: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """(image_id, new_width, new_height) of `images` (image_id, width, height), as `calculate_resize` says for each."""
    whole = lambda a, by, over: F.when(over != 0, (a * by / over + 0.5).cast("int")).otherwise(0)
    w, h = F.col("width"), F.col("height")
    new_w = F.lit(width) if width is not None else w if height is None else whole(w, F.lit(height), h)
    new_h = F.lit(height) if height is not None else h if width is None else whole(h, F.lit(width), w)
    return images.select("image_id", new_w.cast("int").alias("new_width"), new_h.cast("int").alias("new_height"))


def fitted_sizes(images: DataFrame, container: Sequence[int], mode: str = "fit") -> DataFrame:
    """(image_id, new_width, new_height) of `images` (image_id, width, height) in a container, as `fit` says for each."""
    if mode not in FIT_MODES:
        raise ValueError(f"unknown fit mode {mode}")
    w, h = (F.greatest(F.col(c), F.lit(0)) for c in ("width", "height"))
    cw, ch = (F.lit(max(v, 0)) for v in container)
    ratio = (F.least if mode == "fit" else F.greatest)(cw / w, ch / h)
    scaled = lambda v: F.when((w > 0) & (h > 0), (v * ratio + 0.5).cast("int")).otherwise(0)
    new = {"none": (w, h), "stretch": (cw, ch)}.get(mode, (scaled(w), scaled(h)))
    return images.select("image_id", new[0].cast("int").alias("new_width"), new[1].cast("int").alias("new_height"))


def calculate_resize(size: Sequence[int], width: int | None = None, height: int | None = None) -> tuple[int, int]:
    """The missing dimension follows the aspect ratio."""
    w, h = size
    if width is None and height is None:
        return w, h
    if width is None:
        return int(w * height / h + 0.5) if h else 0, height
    return width, height if height is not None else (int(h * width / w + 0.5) if w else 0)


def fit(size: Sequence[int], container: Sequence[int], mode: str = "fit") -> tuple[int, int]:
    """Size of an image in a container: none, stretch, fit (inside) or fill (covering)."""
    w, h = (max(v, 0) for v in size)
    cw, ch = (max(v, 0) for v in container)
    if mode == "none":
        return w, h
    if mode == "stretch":
        return cw, ch
    if mode not in FIT_MODES:
        raise ValueError(f"unknown fit mode {mode}")
    if not (w and h):
        return 0, 0
    ratio = (min if mode == "fit" else max)(cw / w, ch / h)
    return int(w * ratio + 0.5), int(h * ratio + 0.5)


def crop(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The part inside the rectangle, clipped to the image: a range filter on the scan and a shift."""
    x0, y0 = max(x, 0), max(y, 0)
    inside = df.where((F.col("x") >= x0) & (F.col("x") < x + w) & (F.col("y") >= y0) & (F.col("y") < y + h))
    least = F.least(F.lit(x + w), F.col("width")) - x0, F.least(F.lit(y + h), F.col("height")) - y0
    return inside.withColumns({"width": least[0], "height": least[1]}).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def extract(df: DataFrame, x: int, y: int, w: int, h: int, default: Sequence[int] = (0, 0, 0, 0)) -> DataFrame:
    """A w x h image at (x, y); what lies outside is `default`."""
    inside = df.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y}).drop("width", "height")
    cells = grid(df.select("image_id").distinct(), w, h)
    joined = cells.join(inside, ["image_id", "x", "y"], "left")
    return joined.select("image_id", "width", "height", "x", "y", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(CHANNELS, default, strict=True)])


def pad(df: DataFrame, left: int, top: int, right: int, bottom: int, fill: Sequence[int] = (0, 0, 0, 0)) -> DataFrame:
    """A larger canvas of `fill` with the image at (left, top).

    The border is generated and put beside the moved pixels: a union, not a join.
    """
    moved = df.withColumns({"x": F.col("x") + left, "y": F.col("y") + top}).withColumns({"width": F.col("width") + left + right, "height": F.col("height") + top + bottom})
    images = df.groupBy("image_id").agg(F.first("width").alias("w"), F.first("height").alias("h"))
    whole = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") + (top + bottom - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") + (left + right - 1))))
    inside = F.col("x").between(F.lit(left), F.col("w") + (left - 1)) & F.col("y").between(F.lit(top), F.col("h") + (top - 1))
    border = whole.where(~inside).select("image_id", (F.col("w") + left + right).alias("width"), (F.col("h") + top + bottom).alias("height"), "x", "y", *[F.lit(v).alias(c) for c, v in zip(CHANNELS, fill, strict=True)])
    return moved.select(*border.columns).unionByName(border)


def flip_vert(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.col("height") - 1 - F.col("y"))


def flip_horz(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.col("width") - 1 - F.col("x"))


def rotate180(df: DataFrame) -> DataFrame:
    return flip_horz(flip_vert(df))


def rotate90(df: DataFrame) -> DataFrame:
    """Clockwise."""
    return df.withColumns({"x": F.col("height") - 1 - F.col("y"), "y": F.col("x"), "width": F.col("height"), "height": F.col("width")})


def rotate90_ccw(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("y"), "y": F.col("width") - 1 - F.col("x"), "width": F.col("height"), "height": F.col("width")})


def pixel_at(df: DataFrame, x: int, y: int) -> DataFrame:
    """One pixel of each image; outside it is transparent black."""
    hit = (F.col("x") == x) & (F.col("y") == y)
    return df.groupBy("image_id").agg(*[F.coalesce(F.max(F.when(hit, F.col(c))), F.lit(0)).alias(c) for c in CHANNELS])


def set_pixel(df: DataFrame, x: int, y: int, color: Sequence[int]) -> DataFrame:
    hit = (F.col("x") == x) & (F.col("y") == y)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in zip(CHANNELS, color, strict=True)})

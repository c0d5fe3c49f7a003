"""Histograms, tests, extents and hashes: aggregations over pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS


def histogram(df: DataFrame, include_alpha: bool = False, by_image: bool = True) -> DataFrame:
    """(image_id, r, g, b, a, count), or over all images; alpha counts as 255 unless included."""
    alpha = F.col("a") if include_alpha else F.lit(255)
    keys = [*(["image_id"] if by_image else []), "r", "g", "b", alpha.alias("a")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def ordered_histogram(df: DataFrame, include_alpha: bool = False) -> DataFrame:
    """Most frequent first; ties by alpha, red, green, blue."""
    return histogram(df, include_alpha, False).orderBy(F.col("count").desc(), "a", "r", "g", "b")


def is_grayscale(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))).alias("grayscale"))


def single_channel(df: DataFrame) -> DataFrame:
    """(image_id, channel): the only non-zero colour channel, or none."""
    bits = df.groupBy("image_id").agg(*[F.bit_or(c).alias(c) for c in "rgb"])
    r, g, b = (F.col(c) != 0 for c in "rgb")
    return bits.select("image_id", F.when(r & ~g & ~b, "red").when(g & ~r & ~b, "green").when(b & ~r & ~g, "blue").otherwise("none").alias("channel"))


def _inside(x: int, y: int, w: int, h: int):
    return F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)


def content_size(df: DataFrame, x: int, y: int, w: int, h: int, cutoff: int = 0) -> DataFrame:
    """(image_id, content_width, content_height): the extent, from the rectangle's corner, of what is above `cutoff` in alpha."""
    seen = _inside(x, y, w, h) & (F.col("a") > cutoff)
    return df.groupBy("image_id").agg(F.coalesce(F.max(F.when(seen, F.col("x") - x + 1)), F.lit(0)).alias("content_width"), F.coalesce(F.max(F.when(seen, F.col("y") - y + 1)), F.lit(0)).alias("content_height"))


def is_rect_transparent(df: DataFrame, x: int, y: int, w: int, h: int, cutoff: int = 0) -> DataFrame:
    """Whether nothing in the clipped rectangle is above `cutoff`; an empty rectangle is transparent."""
    return df.groupBy("image_id").agg((~F.coalesce(F.bool_or(_inside(x, y, w, h) & (F.col("a") > cutoff)), F.lit(False))).alias("transparent"))


def is_row_transparent(df: DataFrame, x: int, y: int, w: int, cutoff: int = 0) -> DataFrame:
    return is_rect_transparent(df, x, y, w, 1, cutoff)


def is_column_transparent(df: DataFrame, x: int, y: int, h: int, cutoff: int = 0) -> DataFrame:
    return is_rect_transparent(df, x, y, 1, h, cutoff)


def image_hash(df: DataFrame) -> DataFrame:
    """(image_id, hash): h * 65599 + pixel modulo 2^32 in row-major order, r in the pixel's low byte.

    The fold is a polynomial, so each row is folded by itself and rows are then folded with the factor
    65599^width: no group holds more than a row of pixels or an image's column of row hashes.
    """
    mod = F.lit(1 << 32)
    word = F.col("r").cast("long") + F.col("g") * 256 + F.col("b") * 65_536 + F.col("a").cast("long") * 16_777_216
    in_row = F.sort_array(F.collect_list(F.struct("x", word.alias("p"))))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = df.groupBy("image_id", "width", "y").agg(F.aggregate(in_row, zero, lambda h, s: F.pmod(h * 65_599 + s["p"], mod)).alias("h"))
    rows = rows.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.col("width")), one, lambda acc, _: F.pmod(acc * 65_599, mod)))
    # A product of two 32-bit numbers modulo 2^32 goes in halves of the factor, which do not overflow.
    in_image = F.sort_array(F.collect_list(F.struct("y", "h", F.pmod("f", F.lit(65_536)).alias("low"), F.shiftright("f", 16).alias("high"))))
    step = lambda h, s: F.pmod(h * s["low"] + F.pmod(h * s["high"], F.lit(65_536)) * 65_536 + s["h"], mod)
    return rows.groupBy("image_id").agg(F.aggregate(in_image, zero, step).alias("hash"))

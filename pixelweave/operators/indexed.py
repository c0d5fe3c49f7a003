"""Single-channel (palette index) images: rows with one value column `v`.

Arithmetic wraps modulo 256 where truecolour clamps. Palettes are relations (idx, r, g, b, a), so every
operator of `point` applies to them as it does to pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .point import luminance

KEYS = ("image_id", "width", "height", "x", "y")


def _put(df: DataFrame, v: Column) -> DataFrame:
    return df.withColumn("v", v.cast("int"))


def pair(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right.select("image_id", "x", "y", F.col("v").alias("s")), ["image_id", "x", "y"], how)


#: Combination of destination d and source s by name.
_OPS = {
    "add": lambda d, s: (d + s).bitwiseAND(255), "sub": lambda d, s: (d - s).bitwiseAND(255), "mul": lambda d, s: (d * s).bitwiseAND(255), "rsub": lambda d, s: F.greatest(s - d, F.lit(0)),
    "or": lambda d, s: d.bitwiseOR(s), "and": lambda d, s: d.bitwiseAND(s), "xor": lambda d, s: d.bitwiseXOR(s), "mask": lambda d, s: d.bitwiseAND(255 - s),
    "copy": lambda d, s: s, "transparent": lambda d, s: F.when(s != 0, s).otherwise(d),
}


def combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """Pixel by pixel; add, sub and mul wrap, rsub stops at 0."""
    return pair(left, right).select(*KEYS, _OPS[op](F.col("v"), F.col("s")).cast("int").alias("v"))


def blit(dest: DataFrame, source: DataFrame, op: str, at: tuple[int, int] = (0, 0)) -> DataFrame:
    """`source` drawn on `dest` at a place; what lands outside finds no partner."""
    moved = source.withColumns({"x": F.col("x") + at[0], "y": F.col("y") + at[1]})
    joined = pair(dest, moved, "left")
    return joined.select(*KEYS, F.when(F.col("s").isNotNull(), _OPS[op](F.col("v"), F.col("s"))).otherwise(F.col("v")).cast("int").alias("v"))


def invert(df: DataFrame) -> DataFrame:
    return _put(df, 255 - F.col("v"))


def negate(df: DataFrame) -> DataFrame:
    return _put(df, (256 - F.col("v")) % 256)


def times(df: DataFrame, k: int) -> DataFrame:
    return _put(df, F.pmod(F.col("v") * k, F.lit(256)))


def shifted(df: DataFrame, n: int) -> DataFrame:
    if abs(n) >= 8:
        return _put(df, F.lit(0))
    return _put(df, F.shiftleft("v", n).bitwiseAND(255) if n >= 0 else F.shiftright("v", -n))


def remap(df: DataFrame, table: Sequence[int]) -> DataFrame:
    if len(table) < 256:
        raise ValueError("a table has 256 entries")
    return _put(df, F.element_at(F.array(*[F.lit(int(v)) for v in table[:256]]), F.col("v") + 1))


def to_grayscale256(df: DataFrame, palette: DataFrame) -> DataFrame:
    """Indices become the luminance of their palette entry (at most 256 rows, broadcast)."""
    gray = palette.select(F.col("idx").alias("v"), luminance({c: F.col(c) for c in "rgb"}).cast("int").alias("to"))
    return df.join(F.broadcast(gray), "v").select(*KEYS, F.col("to").alias("v"))


def is_grayscale256(palette: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, identity): whether each palette is the opaque identity ramp of 256 entries."""
    same = (F.col("r") == F.col("idx")) & (F.col("g") == F.col("idx")) & (F.col("b") == F.col("idx")) & (F.col("a") == 255)
    return palette.groupBy(key).agg((F.bool_and(same) & (F.count(F.lit(1)) == 256)).alias("identity"))


def content_size(df: DataFrame, x: int, y: int, w: int, h: int, cutoff: int = 0) -> DataFrame:
    """Extent, from the rectangle's corner, of indices above `cutoff`."""
    seen = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1) & (F.col("v") > cutoff)
    return df.groupBy("image_id").agg(F.coalesce(F.max(F.when(seen, F.col("x") - x + 1)), F.lit(0)).alias("content_width"), F.coalesce(F.max(F.when(seen, F.col("y") - y + 1)), F.lit(0)).alias("content_height"))

"""Convolutions. Window partitions are pieces of an image's rows and columns with a margin that covers the kernel, so
a large image spreads over tasks whatever its shape; taps outside the image are null and drop out. Terms are added in a
fixed order in doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import RGB, to_byte
from .point import put

# Kernels of the named filters.
EMBOSS = (-2, -1, 0, -1, 1, 1, 0, 1, 2)
SHARPEN = (0, -1, 0, -1, 5, -1, 0, -1, 0)
EDGES4 = (0, -1, 0, -1, 4, -1, 0, -1, 0)
EDGES8 = (-1, -1, -1, -1, 8, -1, -1, -1, -1)
BOX = (1,) * 9
ROUND = (1, 2, 1, 2, 4, 2, 1, 2, 1)


#: Pixels of a line that one window holds, margins aside.
PIECE = 512


def _pieces(df: DataFrame, axis: str, reach: int) -> tuple[DataFrame, Window, Column]:
    """`df` dealt to pieces of its lines along `axis`, pixels within `reach` of a border to both sides of it; the
    window of a piece, and whether a row is at home in it (the others only serve as neighbours)."""
    across = "y" if axis == "x" else "x"
    at = lambda shift: F.floor((F.col(axis) + shift) / PIECE)
    dealt = df.withColumn("__piece", F.explode(F.sequence(F.greatest(at(-reach), F.lit(0)), at(reach))))
    return dealt, Window.partitionBy("image_id", across, "__piece").orderBy(axis), F.col("__piece") == at(0)


def _add(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _weighted(taps: Sequence[tuple[Column, float]], divide: bool) -> Column:
    """Sum of in-image taps, over their weights' sum (0 counts as 1) if asked."""
    total = _add([F.coalesce(v * w, F.lit(0.0)) for v, w in taps])
    if not divide:
        return total
    weights = _add([F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in taps])
    return total / F.when(weights == 0, 1.0).otherwise(weights)


def _blended(kernel: Sequence[float], strength: float, middle: int) -> list[float]:
    return [float(k) * strength + (1 - strength if i == middle else 0.0) for i, k in enumerate(kernel)]


def convolve(df: DataFrame, kernel: Sequence[float], kw: int, kh: int, strength: float = 1.0, divide: bool = False, channels: Sequence[str] = RGB) -> DataFrame:
    """kw x kh stencil (odd sizes), row-major; `strength` blends with the identity. rgb clamp, alpha stays.

    Two window passes without a join: the columns of a pixel's neighbourhood are gathered along the row,
    then the rows along the column.
    """
    if kw % 2 == 0 or kh % 2 == 0 or len(kernel) != kw * kh:
        raise ValueError("the kernel must have odd sides and kw * kh entries")
    k = _blended(kernel, strength, kw * kh // 2)
    rx, ry = kw // 2, kh // 2
    dealt, row, home = _pieces(df, "x", rx)
    gathered = {c: F.array(*[F.lag(c, -dx).over(row) for dx in range(-rx, rx + 1)]) for c in channels}
    wide = dealt.withColumns({f"__{c}": v for c, v in gathered.items()}).where(home)
    dealt, column, home = _pieces(wide.drop("__piece"), "y", ry)
    rows = dealt.withColumns({f"__{c}_{j}": F.lag(f"__{c}", -(j - ry)).over(column) for c in channels for j in range(kh)}).where(home)
    taps = lambda c: [(F.get(f"__{c}_{j}", F.lit(i)), k[j * kw + i]) for j in range(kh) for i in range(kw)]
    out = put(rows, {c: to_byte(_weighted(taps(c), divide)) for c in channels})
    return out.select(*df.columns)


def convolve3x3(df: DataFrame, kernel: Sequence[float], strength: float = 1.0, divide: bool = False) -> DataFrame:
    return convolve(df, kernel, 3, 3, strength, divide)


def emboss(df: DataFrame, strength: float = 1.0) -> DataFrame:
    return convolve3x3(df, EMBOSS, strength)


def sharpen(df: DataFrame, strength: float = 1.0) -> DataFrame:
    return convolve3x3(df, SHARPEN, strength)


def edge_detect(df: DataFrame, strength: float = 1.0, diagonals: bool = False) -> DataFrame:
    return convolve3x3(df, EDGES8 if diagonals else EDGES4, strength)


def box_blur(df: DataFrame, strength: float = 1.0) -> DataFrame:
    return convolve3x3(df, BOX, strength, True)


def round_blur(df: DataFrame, strength: float = 1.0) -> DataFrame:
    return convolve3x3(df, ROUND, strength, True)


def convolve_line(df: DataFrame, kernel: Sequence[float], axis: str, strength: float = 1.0, divide: bool = False) -> DataFrame:
    """One-dimensional kernel of odd length along x or y; `strength` applies once."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel must be of odd length")
    half = len(kernel) // 2
    k = _blended(kernel, strength, half)
    dealt, w, home = _pieces(df, axis, half)
    taps = {c: [(F.lag(c, -(i - half)).over(w), k[i]) for i in range(len(k))] for c in RGB}
    rows = dealt.withColumns({f"__{c}": _weighted(t, divide) for c, t in taps.items()}).where(home)
    return put(rows, {c: to_byte(F.col(f"__{c}")) for c in RGB}).select(*df.columns)


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    half = size // 2
    raw = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma) for i in range(size)]
    return [v / sum(raw) for v in raw]


def gaussian_blur(df: DataFrame, radius: float, sigma: float | None = None, strength: float = 1.0) -> DataFrame:
    """Separable: along the rows, rounded to bytes, then along the columns."""
    kernel = gaussian_kernel(2 * math.ceil(radius) + 1, sigma or radius / 2)
    return convolve_line(convolve_line(df, kernel, "x", strength, True), kernel, "y", strength, True)

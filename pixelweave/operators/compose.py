"""Combining images: arithmetic on pairs, blits and pattern blits. All are joins on coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, Color, black_over, clamp8, color, columns, div255, over, over_pm, scale, white_over, white_over_pm

KEYS = ("image_id", "width", "height", "x", "y")


def pair(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels of two images at equal coordinates; the second's channels are s_r, s_g, s_b, s_a.

    Both sides shuffle on (image_id, x, y), so one very large image spreads over all tasks.
    """
    s = right.select("image_id", "x", "y", *[F.col(c).alias(f"s_{c}") for c in CHANNELS])
    return left.join(s, ["image_id", "x", "y"], how)


def combine(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """add, sub, mul, or, and, xor of all channels; add and sub clamp, mul is on the 0..1 scale."""
    d, s = columns(), columns("s_")
    f = {
        "add": lambda a, b: F.least(a + b, F.lit(255)), "sub": lambda a, b: F.greatest(a - b, F.lit(0)), "mul": lambda a, b: div255(a * b),
        "or": lambda a, b: a.bitwiseOR(b), "and": lambda a, b: a.bitwiseAND(b), "xor": lambda a, b: a.bitwiseXOR(b),
    }[op]
    return pair(left, right).select(*KEYS, *[f(d[c], s[c]).cast("int").alias(c) for c in CHANNELS])


def mix(left: DataFrame, right: DataFrame, amount: float = 0.5) -> DataFrame:
    """`amount` of the second image in 16.16, without rounding."""
    m = int(amount * 65_536 + 0.5)
    d, s = columns(), columns("s_")
    return pair(left, right).select(*KEYS, *[F.shiftright(s[c] * m + d[c] * (65_536 - m), 16).alias(c) for c in CHANNELS])


def same(left: DataFrame, right: DataFrame) -> DataFrame:
    """(image_id, same boolean): whether both images have equal pixels."""
    d, s = columns(), columns("s_")
    equal = F.lit(True)
    for c in CHANNELS:
        equal = equal & d[c].eqNullSafe(s[c])
    return pair(left, right, "full").groupBy("image_id").agg(F.bool_and(equal).alias("same"))


#: Blit modes by name.
MODES = ("copy", "transparent", "alpha", "alpha_pm", "multiply", "add", "sub", "rsub", "or", "and", "xor", "mask", "black_alpha", "black_alpha_pm", "white_alpha", "white_alpha_pm", "color", "color_transparent", "color_alpha", "color_alpha_pm")


def blend(mode: str, s: Color, d: Color, tint: Sequence[int] = (255, 255, 255, 255)) -> Color:
    """The destination colour after source `s` is drawn on `d`."""
    if mode in ("color", "color_transparent", "color_alpha", "color_alpha_pm"):
        s = scale(s, color(*tint))
        mode = {"color": "copy", "color_transparent": "transparent", "color_alpha": "alpha", "color_alpha_pm": "alpha_pm"}[mode]
    each = lambda f: {c: f(s[c], d[c]) for c in CHANNELS}
    if mode == "copy":
        return s
    if mode == "transparent":
        return each(lambda a, b: F.when(s["a"] != 0, a).otherwise(b))
    if mode == "alpha":
        return over(s, d)
    if mode == "alpha_pm":
        return over_pm(s, d)
    if mode == "multiply":
        return each(lambda a, b: div255(a * b))
    if mode == "add":
        return each(lambda a, b: clamp8(a + b))
    if mode == "sub":
        return each(lambda a, b: clamp8(b - a))
    if mode == "rsub":
        return each(lambda a, b: clamp8(a - b))
    if mode == "or":
        return each(lambda a, b: a.bitwiseOR(b))
    if mode == "and":
        return each(lambda a, b: a.bitwiseAND(b))
    if mode == "xor":
        return each(lambda a, b: a.bitwiseXOR(b))
    if mode == "mask":  # the complement leaves alpha as it is
        return {c: d[c].bitwiseAND(255 - s[c]) for c in "rgb"} | {"a": d["a"].bitwiseAND(s["a"])}
    if mode in ("black_alpha", "black_alpha_pm"):
        return black_over(s["a"], d)
    if mode == "white_alpha":
        return white_over(s["a"], d)
    if mode == "white_alpha_pm":
        return white_over_pm(s["a"], d)
    raise ValueError(f"unknown blit mode {mode}")


def blit(dest: DataFrame, source: DataFrame, mode: str = "copy", src: tuple[int, int] = (0, 0), at: tuple[int, int] = (0, 0), size: tuple[int, int] | None = None, flip_horz: bool = False, flip_vert: bool = False, tint: Sequence[int] = (255, 255, 255, 255)) -> DataFrame:
    """Rectangle `size` of `source` at `src`, drawn on `dest` at `at`; images pair by image_id.

    Clipping is the join itself: source pixels that land outside find no partner. Flips mirror the
    rectangle that is left after clipping to the source.
    """
    w, h = size or (None, None)
    x0, y0 = max(src[0], 0), max(src[1], 0)
    x1 = F.col("width") if w is None else F.least(F.col("width"), F.lit(src[0] + w))
    y1 = F.col("height") if h is None else F.least(F.col("height"), F.lit(src[1] + h))
    inside = source.where((F.col("x") >= x0) & (F.col("y") >= y0) & (F.col("x") < x1) & (F.col("y") < y1))
    ox, oy = at[0] + x0 - src[0], at[1] + y0 - src[1]
    nx = (F.lit(ox) + x1 - 1 - F.col("x")) if flip_horz else F.col("x") - x0 + ox
    ny = (F.lit(oy) + y1 - 1 - F.col("y")) if flip_vert else F.col("y") - y0 + oy
    moved = inside.select("image_id", nx.alias("__x"), ny.alias("__y"), *CHANNELS).withColumnsRenamed({"__x": "x", "__y": "y"})
    joined = pair(dest, moved, "left")
    out = blend(mode, columns("s_"), columns(), tint)
    hit = F.col("s_a").isNotNull()
    return joined.select(*KEYS, *[F.when(hit, out[c]).otherwise(F.col(c)).cast("int").alias(c) for c in CHANNELS])


def pattern_blit(dest: DataFrame, source: DataFrame, src: tuple[int, int, int, int], target: tuple[int, int, int, int]) -> DataFrame:
    """Rectangle `src` (x, y, w, h) of `source` tiled over rectangle `target` of `dest`; the phase starts at
    the target's corner also where that lies outside. Source pixels are keyed by their place in the tile."""
    sx, sy, sw, sh = src
    tx, ty, tw, th = target
    if sw <= 0 or sh <= 0:
        raise ValueError("the source rectangle is empty")
    tile = source.where(F.col("x").between(sx, sx + sw - 1) & F.col("y").between(sy, sy + sh - 1)).select("image_id", (F.col("x") - sx).alias("px"), (F.col("y") - sy).alias("py"), *[F.col(c).alias(f"s_{c}") for c in CHANNELS])
    hit = F.col("x").between(tx, tx + tw - 1) & F.col("y").between(ty, ty + th - 1)
    keyed = dest.withColumn("px", F.when(hit, F.pmod(F.col("x") - tx, F.lit(sw)))).withColumn("py", F.when(hit, F.pmod(F.col("y") - ty, F.lit(sh))))
    joined = keyed.join(tile, ["image_id", "px", "py"], "left")
    return joined.select(*KEYS, *[F.coalesce(f"s_{c}", c).alias(c) for c in CHANNELS])

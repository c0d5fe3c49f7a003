"""Per-pixel operators: projections of the pixel rows, all inside one codegen stage."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, RGB, Color, clamp8, columns, div255, to_byte, to_hsb, to_hsl, with_hsb, with_hsl


def put(df: DataFrame, channels: Mapping[str, Column]) -> DataFrame:
    """`df` with some channels replaced, as INT."""
    return df.withColumns({k: v.cast("int") for k, v in channels.items()})


def multiply(df: DataFrame, r: float, g: float, b: float, a: float = 1.0) -> DataFrame:
    return put(df, {k: to_byte(F.col(k) * float(f)) for k, f in zip(CHANNELS, (r, g, b, a), strict=True)})


def to_rgb(df: DataFrame) -> DataFrame:
    """Without the alpha channel."""
    return df.drop("a")


def to_rgba(df: DataFrame, alpha: int = 255) -> DataFrame:
    """With an alpha channel of one value."""
    return df.withColumn("a", F.lit(alpha))


def premultiply_alpha(df: DataFrame) -> DataFrame:
    return put(df, {k: div255(F.col(k) * F.col("a")) for k in RGB})


def remap_color(df: DataFrame, source: Sequence[int], target: Sequence[int]) -> DataFrame:
    """Exactly `source` (r, g, b, a) becomes `target`."""
    hit = F.lit(True)
    for k, v in zip(CHANNELS, source, strict=True):
        hit = hit & (F.col(k) == v)
    return put(df, {k: F.when(hit, v).otherwise(F.col(k)) for k, v in zip(CHANNELS, target, strict=True)})


def remap_colors(df: DataFrame, mapping: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """Colours of `mapping` (r, g, b, a, to_r, to_g, to_b, to_a; unique sources) are replaced.

    A mapping of at most `most_broadcast` rows is broadcast, a larger one is joined by a shuffle.
    """
    small = mapping.limit(most_broadcast + 1).count() <= most_broadcast
    side = F.broadcast(mapping) if small else mapping
    joined = df.join(side, list(CHANNELS), "left")
    return joined.select(*[F.coalesce(f"to_{c}", c).alias(c) if c in CHANNELS else F.col(c) for c in df.columns])


def remap_matrix(df: DataFrame, m: Sequence[Sequence[float]]) -> DataFrame:
    """rgb times a 3 x 3 matrix, on the 0..1 scale; alpha stays."""
    unit = [F.col(k) / 255.0 for k in RGB]
    row = lambda w: w[0] * unit[0] + w[1] * unit[1] + w[2] * unit[2]
    return put(df, {k: to_byte(row([float(x) for x in m[i]]) * 255.0) for i, k in enumerate(RGB)})


def extract_channel(df: DataFrame, channel: str) -> DataFrame:
    """One channel as a single-channel image `v`."""
    return df.select(*[c for c in df.columns if c not in CHANNELS], F.col(channel).alias("v"))


def swap_channels(df: DataFrame, r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> DataFrame:
    return put(df, {k: F.col(s) for k, s in zip(CHANNELS, (r, g, b, a), strict=True)})


def silhouette(df: DataFrame, color: Sequence[int], premultiplied: bool = False) -> DataFrame:
    value = lambda v: div255(F.lit(v) * F.col("a")) if premultiplied else F.lit(v)
    return put(df, {k: value(v) for k, v in zip(RGB, color, strict=False)})


# ------------------------------------------------------------------ look-up tables


def lookup(df: DataFrame, tables: Mapping[str, Sequence[int]]) -> DataFrame:
    """Channels through 256-entry tables, which are literals of the plan."""
    for name, t in tables.items():
        if len(t) < 256:
            raise ValueError(f"the table of {name} has {len(t)} entries, not 256")
    return put(df, {k: F.element_at(F.array(*[F.lit(int(v)) for v in t[:256]]), F.col(k) + 1) for k, t in tables.items()})


def _clamp(v: float) -> int:
    return min(max(int(v), 0), 255)


def gamma_table(g: float) -> list[int]:
    return [_clamp(math.pow(i / 255, g) * 255 + 0.5) for i in range(256)]


def gamma(df: DataFrame, r: float, g: float | None = None, b: float | None = None) -> DataFrame:
    """One exponent remaps all four channels, three leave alpha."""
    if g is None or b is None:
        return lookup(df, {k: gamma_table(r) for k in CHANNELS})
    return lookup(df, {"r": gamma_table(r), "g": gamma_table(g), "b": gamma_table(b)})


def range_table(least: float, width: float) -> list[int]:
    return [_clamp(math.floor(least + i * width / 256 + 0.5)) for i in range(256)]


def adjust_range(df: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Each named channel through min + v * range / 256."""
    return lookup(df, {k: range_table(*v) for k, v in ranges.items()})


def brightness_contrast(df: DataFrame, brightness: float, contrast: float) -> DataFrame:
    """Both 0 change nothing; the range is max - min, alpha stays."""
    low, high = brightness - (1 + contrast), brightness + (1 + contrast)
    least, most = 256 * (low / 2 + 0.5), 256 * (high / 2 + 0.5)
    return adjust_range(df, **{k: (least, most - least) for k in RGB})


# A published fit to the colour of a black body, t in hundreds of kelvin: a * (t - shift) ** power for red
# and for green above 66, a * ln(t - shift) + b for green up to 66 and for blue.
RED_POWER = (329.698727446, 60, -0.1332047592)
GREEN_POWER = (288.1221695283, 60, -0.0755148492)
GREEN_LOG = (99.4708025861, 0, -161.1195681661)
BLUE_LOG = (138.5177312231, 10, -305.0447927307)


def color_temperature(df: DataFrame, kelvin: float) -> DataFrame:
    """White of a black body; 6600 K is nearly neutral. Alpha stays."""
    t = min(max(kelvin, 1000.0), 40_000.0) / 100
    power = lambda a, shift, e: a * math.pow(t - shift, e)
    log = lambda a, shift, b: a * math.log(t - shift) + b
    red = 255.0 if t <= 66 else power(*RED_POWER)
    green = log(*GREEN_LOG) if t <= 66 else power(*GREEN_POWER)
    blue = 255.0 if t >= 66 else 0.0 if t <= 19 else log(*BLUE_LOG)
    unit = lambda v: (0.0, min(max(v, 0.0), 255.0) * 256 / 255)
    return adjust_range(df, r=unit(red), g=unit(green), b=unit(blue))


def fuse(tables: Sequence[Sequence[int]]) -> list[int]:
    """Several look-up tables in a row as one."""
    out = list(range(256))
    for t in tables:
        out = [t[v] for v in out]
    return out


# ------------------------------------------------------------------ gray and hue


def luminance(c: Color, relative: bool = True, weights: Sequence[float] = (0.299, 0.587, 0.114)) -> Column:
    """16.16 weighted sum, or the plain mean by (r + g + b) * 683 >> 11."""
    if not relative:
        return F.shiftright((c["r"] + c["g"] + c["b"]) * 683, 11)
    w = [int(x * 65_536 + 0.5) for x in weights]
    if sum(w) > 65_536:
        raise ValueError("the weights exceed 1")
    return F.shiftright(c["r"] * w[0] + c["g"] * w[1] + c["b"] * w[2] + 32_768, 16)


def grayscale(df: DataFrame, relative: bool = True, weights: Sequence[float] = (0.299, 0.587, 0.114)) -> DataFrame:
    y = luminance(columns(), relative, weights)
    return put(df, {k: y for k in RGB})


def grayscale8(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in CHANNELS], luminance(columns()).cast("int").alias("v"))


def desaturate(df: DataFrame, amount: float) -> DataFrame:
    """`amount` is the fraction of colour that is kept."""
    v = min(max(int(amount * 256 + 0.5), 0), 256)
    y = luminance(columns())
    return put(df, {k: F.shiftright(F.col(k) * v + y * (256 - v), 8) for k in RGB})


def sepia(df: DataFrame, amount: float = 0.125) -> DataFrame:
    i = float(int(min(max(amount, -1.0), 1.0) * 255 + 0.5))
    y = luminance(columns()).cast("double")
    return put(df, {"r": to_byte(y + 0.956 * i), "g": to_byte(y - 0.272 * i), "b": to_byte(y - 1.106 * i)})


def invert(df: DataFrame, channels: Sequence[str] = RGB) -> DataFrame:
    return put(df, {k: 255 - F.col(k) for k in channels})


def _shift(v: Column, d: float) -> Column:
    return v * (1.0 - d) + d if d > 0 else v * (1.0 + d)


def _hue_shifted(df: DataFrame, to, back, hue: float, second: float, third: float) -> DataFrame:
    """In steps of named columns, so that no expression is written out many times over."""
    h, s, v = to(columns())
    out = df.withColumns({"__h": h, "__s": s, "__v": v})
    out = out.withColumns({"__h": F.col("__h") + hue, "__s": _shift(F.col("__s"), second), "__v": _shift(F.col("__v"), third)})
    return put(back(out, "__h", "__s", "__v"), {k: F.col(f"__{k}") for k in RGB}).select(*df.columns)


def hue_saturation_lightness(df: DataFrame, hue: float, saturation: float, lightness: float) -> DataFrame:
    """Hue in degrees, the others -1..1; alpha stays."""
    return _hue_shifted(df, to_hsl, with_hsl, hue, saturation, lightness)


def hue_saturation_brightness(df: DataFrame, hue: float, saturation: float, brightness: float) -> DataFrame:
    return _hue_shifted(df, to_hsb, with_hsb, hue, saturation, brightness)


# ------------------------------------------------------------------ scalar operators


def negate(df: DataFrame) -> DataFrame:
    return put(df, {k: (256 - F.col(k)) % 256 for k in RGB})


def times(df: DataFrame, k: int | float) -> DataFrame:
    """By an integer exactly, by a fraction rounded; clamped, alpha stays."""
    return put(df, {c: clamp8(F.col(c) * k) if isinstance(k, int) else to_byte(F.col(c) * k) for c in RGB})


def divided(df: DataFrame, k: int | float) -> DataFrame:
    """By an integer toward zero, by a fraction rounded."""
    if k == 0:
        raise ZeroDivisionError("division of an image by 0")
    return put(df, {c: clamp8((F.col(c) / k).cast("int")) if isinstance(k, int) else to_byte(F.col(c) / k) for c in RGB})


def shifted(df: DataFrame, n: int) -> DataFrame:
    """Left for positive n, right for negative; bytes wrap, 8 or more give 0, alpha stays."""
    if abs(n) >= 8:
        return put(df, {c: F.lit(0) for c in RGB})
    return put(df, {c: F.shiftleft(F.col(c), n).bitwiseAND(255) if n >= 0 else F.shiftright(F.col(c), -n) for c in RGB})


def fill(df: DataFrame, color: Sequence[int]) -> DataFrame:
    return put(df, {k: F.lit(v) for k, v in zip(CHANNELS, color, strict=True)})


def combine_channels(r: DataFrame | None = None, g: DataFrame | None = None, b: DataFrame | None = None, a: DataFrame | None = None) -> DataFrame:
    """Single-channel images (…, v) as one image; a missing colour is 0, a missing alpha 255.

    The parts are stacked and grouped by pixel: one shuffle for any number of parts.
    """
    parts = [(k, d) for k, d in zip(CHANNELS, (r, g, b, a), strict=True) if d is not None]
    if not parts:
        raise ValueError("no channel is given")
    keys = ["image_id", "width", "height", "x", "y"]
    stacked = None
    for k, d in parts:
        one = d.select(*keys, F.lit(k).alias("channel"), "v")
        stacked = one if stacked is None else stacked.unionByName(one)
    empty = {"r": 0, "g": 0, "b": 0, "a": 255}
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("channel") == k, F.col("v"))), F.lit(empty[k])).alias(k) for k in CHANNELS])

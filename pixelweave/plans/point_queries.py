"""Queries of the per-pixel operators, on the 8 x 2 RGBA images of the embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import point as P
from ..sources import fixtures as X
from .sqltext import byte, clamp, d255, each, point

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
OUT = ("image_id", "x", "y", "r", "g", "b", "a")
Y = "((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)"


def on_rgba(name: str, op: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d, op=op: op(X.rgba(spark, d)).select(*OUT)
    ORACLE_SQL[name] = f"WITH {X.RGBA_SQL} {sql}"


on_rgba("g2_multiply", lambda d: P.multiply(d, 1.5, 0.5, 2.0, 0.75), point(r=byte("r * 1.5"), g=byte("g * 0.5"), b=byte("b * 2.0"), a=byte("a * 0.75")))
on_rgba("g4_premultiply", P.premultiply_alpha, each(lambda c: d255(f"{c} * a")))
on_rgba("g5_remap_color", lambda d: P.remap_color(d, (128, 128, 128, 255), (1, 2, 3, 4)), each(lambda c: f"CASE WHEN r = 128 AND g = 128 AND b = 128 AND a = 255 THEN {dict(r=1, g=2, b=3, a=4)[c]} ELSE {c} END", over="rgba"))
on_rgba("g7_remap_matrix", lambda d: P.remap_matrix(d, ((0.5, 0.25, 0.25), (0.0, 1.5, -0.5), (0.25, 0.0, 0.75))),
        point(r=byte("(0.5e0 * (r / 255e0) + 0.25e0 * (g / 255e0) + 0.25e0 * (b / 255e0)) * 255e0"), g=byte("(0e0 * (r / 255e0) + 1.5e0 * (g / 255e0) + -0.5e0 * (b / 255e0)) * 255e0"), b=byte("(0.25e0 * (r / 255e0) + 0e0 * (g / 255e0) + 0.75e0 * (b / 255e0)) * 255e0")))
on_rgba("g13_swap_channels", lambda d: P.swap_channels(d, "b", "g", "r", "a"), point(r="b", b="r"))
on_rgba("h1_silhouette", lambda d: P.silhouette(d, (200, 100, 50)), point(r="200", g="100", b="50"))
on_rgba("h2_silhouette_pm", lambda d: P.silhouette(d, (200, 100, 50), True), point(r=d255("200 * a"), g=d255("100 * a"), b=d255("50 * a")))
on_rgba("h3_gamma", lambda d: P.gamma(d, 0.45), each(lambda c: byte(f"pow({c} / 255e0, 0.45e0) * 255"), over="rgba"))
on_rgba("h3_gamma_rgb", lambda d: P.gamma(d, 0.45, 1.0, 2.2), point(r=byte("pow(r / 255e0, 0.45e0) * 255"), b=byte("pow(b / 255e0, 2.2e0) * 255")))
on_rgba("h4_grayscale", P.grayscale, each(lambda c: Y))
on_rgba("h4_grayscale_mean", lambda d: P.grayscale(d, relative=False), each(lambda c: "((r + g + b) * 683) >> 11"))
on_rgba("h7_desaturate", lambda d: P.desaturate(d, 0.3), each(lambda c: f"({c} * 77 + {Y} * 179) >> 8"))
on_rgba("h8_sepia", P.sepia, point(r=byte(f"CAST({Y} AS DOUBLE) + 0.956e0 * 32e0"), g=byte(f"CAST({Y} AS DOUBLE) - 0.272e0 * 32e0"), b=byte(f"CAST({Y} AS DOUBLE) - 1.106e0 * 32e0")))
on_rgba("h9_invert", P.invert, each(lambda c: f"255 - {c}"))
on_rgba("h10_invert_channel", lambda d: P.invert(d, ("g",)), point(g="255 - g"))
on_rgba("h14_brightness_contrast", lambda d: P.brightness_contrast(d, 0.25, 0.5), each(lambda c: clamp(f"floor(256 * (-1.25e0 / 2 + 0.5e0) + {c} * (256 * (1.75e0 / 2 + 0.5e0) - 256 * (-1.25e0 / 2 + 0.5e0)) / 256 + 0.5e0)")))
on_rgba("h15_adjust_range", lambda d: P.adjust_range(d, r=(10, 100), g=(0, 256), b=(50, -40), a=(255, -255)),
        point(r=clamp("floor(10 + r * 100 / 256e0 + 0.5e0)"), g="g", b=clamp("floor(50 + b * -40 / 256e0 + 0.5e0)"), a=clamp("floor(255 + a * -255 / 256e0 + 0.5e0)")))
on_rgba("h17_remap_values", lambda d: P.lookup(d, {"r": [(i * 7) % 256 for i in range(256)], "a": [255 - i for i in range(256)]}), point(r="(r * 7) % 256", a="255 - a"))
on_rgba("h17_fused_tables", lambda d: P.lookup(d, {"r": P.fuse([[(i * 7) % 256 for i in range(256)], [255 - i for i in range(256)]])}), point(r="255 - (r * 7) % 256"))
on_rgba("h18_color_temperature", lambda d: P.color_temperature(d, 3000), point(
    r=clamp("floor(r * (255e0 * 256 / 255) / 256 + 0.5e0)"),
    g=clamp("floor(g * ((99.4708025861e0 * ln(30e0) - 161.1195681661e0) * 256 / 255) / 256 + 0.5e0)"),
    b=clamp("floor(b * ((138.5177312231e0 * ln(20e0) - 305.0447927307e0) * 256 / 255) / 256 + 0.5e0)")))
on_rgba("i3_negate", P.negate, each(lambda c: f"(256 - {c}) % 256"))
on_rgba("i5_times_int", lambda d: P.times(d, 2), each(lambda c: clamp(f"{c} * 2")))
on_rgba("i6_times_float", lambda d: P.times(d, 0.7), each(lambda c: byte(f"{c} * 0.7e0")))
on_rgba("i7_divided_int", lambda d: P.divided(d, 3), each(lambda c: f"{c} // 3"))
on_rgba("i8_divided_float", lambda d: P.divided(d, 0.7), each(lambda c: byte(f"{c} / 0.7e0")))
on_rgba("i13_shift_left", lambda d: P.shifted(d, 3), each(lambda c: f"({c} << 3) & 255"))
on_rgba("i14_shift_right", lambda d: P.shifted(d, -2), each(lambda c: f"{c} >> 2"))
on_rgba("k1_fill", lambda d: P.fill(d, (9, 8, 7, 6)), point(r="9", g="8", b="7", a="6"))


_HUE = "CASE WHEN mx = mn THEN 0 ELSE (CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) END"
_HSX = f"""hs0 AS (SELECT *, greatest(r, g, b) / 255e0 AS mx, least(r, g, b) / 255e0 AS mn FROM px),
hs1 AS (SELECT *, CASE WHEN mx = mn THEN 0 ELSE 60 * CASE WHEN mx = r / 255e0 THEN (g / 255e0 - b / 255e0) / (mx - mn) WHEN mx = g / 255e0 THEN (b / 255e0 - r / 255e0) / (mx - mn) + 2 ELSE (r / 255e0 - g / 255e0) / (mx - mn) + 4 END END AS h0 FROM hs0),
hs2 AS (SELECT *, {_HUE} AS h, (mx + mn) / 2 AS li, CASE WHEN mx = mn THEN 0 ELSE (mx - mn) / (1 - abs(2 * ((mx + mn) / 2) - 1)) END AS sl, CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx END AS sb FROM hs1)"""
_BACK = """t1 AS (SELECT *, (hh - 360 * floor(hh / 360)) / 60 AS sec FROM t0),
t2 AS (SELECT *, chroma * (1 - abs(sec - 2 * floor(sec / 2) - 1)) AS xx, floor(sec) AS k FROM t1)"""
_RGB = {
    "r": byte("(CASE WHEN k IN (0, 5) THEN chroma WHEN k IN (1, 4) THEN xx ELSE 0 END + low) * 255"),
    "g": byte("(CASE WHEN k IN (1, 2) THEN chroma WHEN k IN (0, 3) THEN xx ELSE 0 END + low) * 255"),
    "b": byte("(CASE WHEN k IN (3, 4) THEN chroma WHEN k IN (2, 5) THEN xx ELSE 0 END + low) * 255"),
}
QUERIES["h12_hue_saturation_lightness"] = lambda spark, d: P.hue_saturation_lightness(X.rgba(spark, d), 40.0, 0.25, -0.125).select(*OUT)
ORACLE_SQL["h12_hue_saturation_lightness"] = f"""WITH {X.RGBA_SQL}, {_HSX},
tt AS (SELECT *, h + 40 AS hh, least(greatest(sl * 0.75e0 + 0.25e0, 0), 1) AS s2, least(greatest(li * 0.875e0, 0), 1) AS l2 FROM hs2),
t0 AS (SELECT *, (1 - abs(2 * l2 - 1)) * s2 AS chroma, l2 - (1 - abs(2 * l2 - 1)) * s2 / 2 AS low FROM tt), {_BACK} {point('t2', **_RGB)}"""
QUERIES["h13_hue_saturation_brightness"] = lambda spark, d: P.hue_saturation_brightness(X.rgba(spark, d), -70.0, -0.25, 0.125).select(*OUT)
ORACLE_SQL["h13_hue_saturation_brightness"] = f"""WITH {X.RGBA_SQL}, {_HSX},
tt AS (SELECT *, h - 70 AS hh, least(greatest(sb * 0.75e0, 0), 1) AS s2, least(greatest(mx * 0.875e0 + 0.125e0, 0), 1) AS v2 FROM hs2),
t0 AS (SELECT *, v2 * s2 AS chroma, v2 - v2 * s2 AS low FROM tt), {_BACK} {point('t2', **_RGB)}"""

QUERIES["g11_extract_channel"] = lambda spark, d: P.extract_channel(X.rgba(spark, d), "b").select("image_id", "x", "y", "v")
ORACLE_SQL["g11_extract_channel"] = f"WITH {X.RGBA_SQL} SELECT image_id, x, y, b AS v FROM px"
QUERIES["h5_grayscale8"] = lambda spark, d: P.grayscale8(X.rgba(spark, d)).select("image_id", "x", "y", "v")
ORACLE_SQL["h5_grayscale8"] = f"WITH {X.RGBA_SQL} SELECT image_id, x, y, CAST({Y} AS INT) AS v FROM px"


def _remap(spark, d):
    px = X.rgba(spark, d)
    rare = px.where("a = 255 AND r % 2 = 0").select("r", "g", "b", "a").distinct()
    return P.remap_colors(px, rare.select("r", "g", "b", "a", F.col("b").alias("to_r"), (255 - F.col("g")).alias("to_g"), F.lit(7).alias("to_b"), F.col("a").alias("to_a"))).select(*OUT)


QUERIES["g6_remap_colors"] = _remap
ORACLE_SQL["g6_remap_colors"] = f"WITH {X.RGBA_SQL} {point(r='CASE WHEN a = 255 AND r % 2 = 0 THEN b ELSE r END', g='CASE WHEN a = 255 AND r % 2 = 0 THEN 255 - g ELSE g END', b='CASE WHEN a = 255 AND r % 2 = 0 THEN 7 ELSE b END')}"


def _combine(spark, d):
    px = X.rgba(spark, d)
    return P.combine_channels(r=P.extract_channel(px, "g"), b=P.extract_channel(px, "r")).select(*OUT)


QUERIES["g12_combine_channels"] = _combine
ORACLE_SQL["g12_combine_channels"] = f"WITH {X.RGBA_SQL} {point(r='g', g='0', b='r', a='255')}"

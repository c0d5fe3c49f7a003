"""Queries of geometry, composition, convolution, resampling, analysis and palettes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.named import palettes
from ..operators import analyze as A
from ..operators import compose as C
from ..operators import geometry as G
from ..operators import palette as Q
from ..operators import point as P
from ..operators import resample as R
from ..operators import stencil as S
from ..sources import fixtures as X
from .sqltext import byte, clamp, d255, over, over_pm

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
OUT = ("image_id", "x", "y", "r", "g", "b", "a")
SIZED = ("image_id", "width", "height", "x", "y", "r", "g", "b", "a")
RGBA = "r, g, b, a"


def add(name: str, fn: Callable, sql: str | None = None, base: str = X.RGBA_SQL) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE_SQL[name] = f"WITH {base}{sql if sql.startswith(',') else ' ' + sql}"


def on_rgba(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None, cols=SIZED) -> None:
    add(name, lambda spark, d: op(X.rgba(spark, d)).select(*cols), sql)


def on_canvas(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None, cols=OUT) -> None:
    add(name, lambda spark, d: op(X.canvas(spark, d)).select(*cols), sql, X.CANVAS_SQL)


# ------------------------------------------------------------------ construction and access
on_rgba("a10_pixel_at", lambda d: G.pixel_at(d, 5, 1), "SELECT image_id, r, g, b, a FROM px WHERE x = 5 AND y = 1", ("image_id", "r", "g", "b", "a"))
on_rgba("a10_set_pixel", lambda d: G.set_pixel(d, 5, 1, (1, 2, 3, 4)), f"SELECT image_id, width, height, x, y, {', '.join(f'CASE WHEN x = 5 AND y = 1 THEN {v} ELSE {c} END AS {c}' for c, v in zip('rgba', (1, 2, 3, 4), strict=True))} FROM px")
on_rgba("a16_to_rgb_and_back", lambda d: P.to_rgba(P.to_rgb(d)), "SELECT image_id, width, height, x, y, r, g, b, 255 AS a FROM px")
add("a2_expand_palette", lambda spark, d: Q.expand(X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int")), palettes()["grayscale16a"]).select(*SIZED),
    "SELECT image_id, width, height, x, y, CAST((v // 16) * 17 AS INT) AS r, CAST((v // 16) * 17 AS INT) AS g, CAST((v // 16) * 17 AS INT) AS b, 255 AS a FROM gy", X.GRAY_SQL)

# ------------------------------------------------------------------ geometry
on_rgba("c1_resize_up", lambda d: G.resize(d, 13, 5), f"SELECT image_id, 13 AS width, 5 AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {RGBA} FROM px, (SELECT unnest(range(0, 13)) AS i), (SELECT unnest(range(0, 5)) AS j) WHERE x = (i * (8 * 65536 // 13)) >> 16 AND y = (j * (2 * 65536 // 5)) >> 16")
on_rgba("c1_resize_down", lambda d: G.resize(d, 3, 1), f"SELECT image_id, 3 AS width, 1 AS height, CAST(i AS INT) AS x, 0 AS y, {RGBA} FROM px, (SELECT unnest(range(0, 3)) AS i) WHERE x = (i * (8 * 65536 // 3)) >> 16 AND y = 0")
on_rgba("c2_resize_to_fit", lambda d: G.resize(d, *G.fit((8, 2), (20, 20), "fit")), f"SELECT image_id, 20 AS width, 5 AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {RGBA} FROM px, (SELECT unnest(range(0, 20)) AS i), (SELECT unnest(range(0, 5)) AS j) WHERE x = (i * (8 * 65536 // 20)) >> 16 AND y = (j * (2 * 65536 // 5)) >> 16")
on_rgba("c5_calculate_resize", lambda d: G.resize(d, *G.calculate_resize((8, 2), width=14)), f"SELECT image_id, 14 AS width, 4 AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {RGBA} FROM px, (SELECT unnest(range(0, 14)) AS i), (SELECT unnest(range(0, CAST(trunc(2 * 14 / 8e0 + 0.5e0) AS INT))) AS j) WHERE x = (i * (8 * 65536 // 14)) >> 16 AND y = (j * (2 * 65536 // 4)) >> 16")
on_rgba("e3_extract", lambda d: G.extract(d, -2, 1, 6, 3), f"SELECT p.image_id, 6 AS width, 3 AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {', '.join(f'coalesce(px.{c}, 0) AS {c}' for c in 'rgba')} FROM (SELECT DISTINCT image_id FROM px) p CROSS JOIN (SELECT unnest(range(0, 6)) AS i) CROSS JOIN (SELECT unnest(range(0, 3)) AS j) LEFT JOIN px ON px.image_id = p.image_id AND px.x = i - 2 AND px.y = j + 1")
on_rgba("e4_crop", lambda d: G.crop(d, 3, 1, 10, 10), f"SELECT image_id, 5 AS width, 1 AS height, x - 3 AS x, y - 1 AS y, {RGBA} FROM px WHERE x >= 3 AND y >= 1")
on_rgba("e5_pad", lambda d: G.pad(d, 1, 2, 3, 1, (9, 8, 7, 6)), f"SELECT p.image_id, 12 AS width, 5 AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {', '.join(f'coalesce(px.{c}, {v}) AS {c}' for c, v in zip('rgba', (9, 8, 7, 6), strict=True))} FROM (SELECT DISTINCT image_id FROM px) p CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 5)) AS j) LEFT JOIN px ON px.image_id = p.image_id AND px.x = i - 1 AND px.y = j - 2")
on_rgba("f1_flip_vert", G.flip_vert, f"SELECT image_id, width, height, x, 1 - y AS y, {RGBA} FROM px")
on_rgba("f2_flip_horz", G.flip_horz, f"SELECT image_id, width, height, 7 - x AS x, y, {RGBA} FROM px")
on_rgba("f3_rotate90", G.rotate90, f"SELECT image_id, 2 AS width, 8 AS height, 1 - y AS x, x AS y, {RGBA} FROM px")
on_rgba("f4_rotate90_ccw", G.rotate90_ccw, f"SELECT image_id, 2 AS width, 8 AS height, y AS x, 7 - x AS y, {RGBA} FROM px")
on_rgba("f5_rotate180", G.rotate180, f"SELECT image_id, width, height, 7 - x AS x, 1 - y AS y, {RGBA} FROM px")


# ------------------------------------------------------------------ pairs of images
def _next(d: DataFrame) -> DataFrame:
    """Each image under the id of the one before it."""
    return d.withColumn("image_id", F.col("image_id") - 1)


_PAIR = "FROM px d JOIN px s ON s.image_id = d.image_id + 1 AND s.x = d.x AND s.y = d.y"


def _pairs(name: str, op: str, f) -> None:
    cols = ", ".join(f"CAST({f('d.' + c, 's.' + c)} AS INT) AS {c}" for c in "rgba")
    on_rgba(name, lambda d: C.combine(d, _next(d), op), f"SELECT d.image_id, d.x, d.y, {cols} {_PAIR}", OUT)


_pairs("i1_add", "add", lambda a, b: f"least({a} + {b}, 255)")
_pairs("i2_sub", "sub", lambda a, b: f"greatest({a} - {b}, 0)")
_pairs("i4_mul", "mul", lambda a, b: d255(f"{a} * {b}"))
_pairs("i10_or", "or", lambda a, b: f"{a} | {b}")
_pairs("i11_and", "and", lambda a, b: f"{a} & {b}")
_pairs("i12_xor", "xor", lambda a, b: f"xor({a}, {b})")
on_rgba("g1_mix", lambda d: C.mix(d, _next(d), 0.3), f"SELECT d.image_id, d.x, d.y, {', '.join(f'CAST((s.{c} * 19661 + d.{c} * 45875) >> 16 AS INT) AS {c}' for c in 'rgba')} {_PAIR}", OUT)
on_rgba("i15_same", lambda d: C.same(d, _next(d)), """SELECT coalesce(d.image_id, s.image_id - 1) AS image_id, coalesce(bool_and(d.r IS NOT DISTINCT FROM s.r AND d.g IS NOT DISTINCT FROM s.g AND d.b IS NOT DISTINCT FROM s.b AND d.a IS NOT DISTINCT FROM s.a), FALSE) AS same
FROM px d FULL JOIN px s ON s.image_id = d.image_id + 1 AND s.x = d.x AND s.y = d.y GROUP BY 1""", ("image_id", "same"))  # fmt: skip

_S, _D = {c: f"s.{c}" for c in "rgba"}, {c: f"d.{c}" for c in "rgba"}
_TINT = (200, 128, 64, 192)
_SC = {c: d255(f"s.{c} * {t} + 128") for c, t in zip("rgba", _TINT, strict=True)}


def _all(f) -> dict[str, str]:
    return {c: f(_S[c], _D[c]) for c in "rgba"}


_BLITS = {
    "copy": _S, "transparent": _all(lambda s, d: f"CASE WHEN s.a <> 0 THEN {s} ELSE {d} END"), "alpha": over(_S, _D), "alpha_pm": over_pm(_S, _D),
    "multiply": _all(lambda s, d: d255(f"{s} * {d}")), "add": _all(lambda s, d: f"least({s} + {d}, 255)"), "sub": _all(lambda s, d: f"greatest({d} - {s}, 0)"), "rsub": _all(lambda s, d: f"greatest({s} - {d}, 0)"),
    "or": _all(lambda s, d: f"{s} | {d}"), "and": _all(lambda s, d: f"{s} & {d}"), "xor": _all(lambda s, d: f"xor({s}, {d})"),
    "mask": {c: f"d.{c} & (255 - s.{c})" for c in "rgb"} | {"a": "d.a & s.a"},
    "black_alpha": over({"r": "0", "g": "0", "b": "0", "a": "s.a"}, _D), "black_alpha_pm": over({"r": "0", "g": "0", "b": "0", "a": "s.a"}, _D),
    "white_alpha": over({"r": "255", "g": "255", "b": "255", "a": "s.a"}, _D), "white_alpha_pm": over_pm(dict.fromkeys("rgba", "s.a"), _D),
    "color": _SC, "color_transparent": {c: f"CASE WHEN {_SC['a']} <> 0 THEN {_SC[c]} ELSE d.{c} END" for c in "rgba"}, "color_alpha": over(_SC, _D), "color_alpha_pm": over_pm(_SC, _D),
}
for _i, _mode in enumerate(C.MODES):
    _cols = ", ".join(f"CAST(CASE WHEN s.image_id IS NULL THEN d.{c} ELSE {_BLITS[_mode][c]} END AS INT) AS {c}" for c in "rgba")
    on_rgba(f"m{_i}_blit_{_mode}", lambda d, mode=_mode: C.blit(d, _next(d), mode, src=(0, 0), at=(2, 0), tint=_TINT), f"SELECT d.image_id, d.x, d.y, {_cols} FROM px d LEFT JOIN px s ON s.image_id = d.image_id + 1 AND s.x = d.x - 2 AND s.y = d.y", OUT)
on_rgba("m20_blit_flipped", lambda d: C.blit(d, _next(d), "copy", src=(1, -1), at=(3, -1), size=(4, 3), flip_horz=True, flip_vert=True), f"SELECT d.image_id, d.x, d.y, {', '.join(f'coalesce(s.{c}, d.{c}) AS {c}' for c in 'rgba')} FROM px d LEFT JOIN px s ON s.image_id = d.image_id + 1 AND s.x BETWEEN 1 AND 4 AND d.x = 3 + 4 - s.x AND d.y = 1 - s.y", OUT)
on_rgba("e12_pattern_blit", lambda d: C.pattern_blit(d, _next(d), (2, 0, 3, 1), (1, -1, 6, 3)), f"SELECT d.image_id, d.x, d.y, {', '.join(f'coalesce(s.{c}, d.{c}) AS {c}' for c in 'rgba')} FROM px d LEFT JOIN px s ON s.image_id = d.image_id + 1 AND d.x BETWEEN 1 AND 6 AND d.y BETWEEN -1 AND 1 AND s.y = 0 AND s.x = 2 + (d.x - 1) % 3", OUT)


# ------------------------------------------------------------------ convolution
def _tap(dx: int, dy: int, c: str) -> str:
    return f"n{dx + 1}{dy + 1}.{c}"


_JOIN9 = "FROM cv d " + " ".join(f"LEFT JOIN cv n{dx + 1}{dy + 1} ON n{dx + 1}{dy + 1}.x = d.x + {dx} AND n{dx + 1}{dy + 1}.y = d.y + {dy}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def _stencil_sql(kernel, strength: float, divide: bool) -> str:
    k = [v * strength + (1 - strength if i == 4 else 0) for i, v in enumerate(kernel)]
    cols = []
    for c in "rgb":
        taps = [(_tap(i % 3 - 1, i // 3 - 1, c), k[i]) for i in range(9)]
        total = " + ".join(f"coalesce({t} * {float(w)!r}e0, 0e0)" for t, w in taps)
        weight = " + ".join(f"CASE WHEN {t} IS NULL THEN 0e0 ELSE {float(w)!r}e0 END" for t, w in taps)
        cols.append(f"{byte(f'({total}) / coalesce(nullif({weight}, 0), 1)' if divide else total)} AS {c}")
    return f"SELECT d.image_id, d.x, d.y, {', '.join(cols)}, d.a {_JOIN9}"


on_canvas("l1_emboss", S.emboss, _stencil_sql(S.EMBOSS, 1.0, False))
on_canvas("l2_sharpen", lambda d: S.sharpen(d, 0.5), _stencil_sql(S.SHARPEN, 0.5, False))
on_canvas("l3_edge_detect", lambda d: S.edge_detect(d, 1.0, True), _stencil_sql(S.EDGES8, 1.0, False))
on_canvas("l4_box_blur", S.box_blur, _stencil_sql(S.BOX, 1.0, True))
on_canvas("l5_round_blur", S.round_blur, _stencil_sql(S.ROUND, 1.0, True))
_K5 = (1.0, 4.0, 6.0, 4.0, 1.0)


def _line_sql(axis: str, other: str) -> str:
    w = f"OVER (PARTITION BY image_id, {other} ORDER BY {axis})"
    cols = []
    for c in "rgb":
        total = " + ".join(f"coalesce(lag({c}, {2 - i}) {w} * {k!r}e0, 0e0)" for i, k in enumerate(_K5))
        weight = " + ".join(f"CASE WHEN lag({c}, {2 - i}) {w} IS NULL THEN 0e0 ELSE {k!r}e0 END" for i, k in enumerate(_K5))
        cols.append(f"{byte(f'({total}) / ({weight})')} AS {c}")
    return f"SELECT image_id, x, y, {', '.join(cols)}, a FROM cv"


on_canvas("l7_convolve_horz", lambda d: S.convolve_line(d, _K5, "x", 1.0, True), _line_sql("x", "y"))
on_canvas("l9_convolve_vert", lambda d: S.convolve_line(d, _K5, "y", 1.0, True), _line_sql("y", "x"))
_K53 = tuple(float(v) for v in range(1, 16))
_OFF = [(dx, dy) for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1, 2)]
on_canvas("l11_convolve_5x3", lambda d: S.convolve(d, _K53, 5, 3, 1.0, True), "SELECT d.image_id, d.x, d.y, " + ", ".join(
    byte(f"sum(n.{c} * (n.x - d.x + 3 + 5 * (n.y - d.y + 1))) / CAST(sum(n.x - d.x + 3 + 5 * (n.y - d.y + 1)) AS DOUBLE)") + f" AS {c}" for c in "rgb"
) + ", d.a FROM cv d JOIN (SELECT *, unnest([-2, -1, 0, 1, 2]) AS ex FROM cv) n0 ON n0.x + n0.ex = d.x AND n0.y BETWEEN d.y - 1 AND d.y + 1 JOIN cv n ON n.x = n0.x AND n.y = n0.y GROUP BY d.image_id, d.x, d.y, d.a")
on_canvas("l12_gaussian_blur", lambda d: S.gaussian_blur(d, 2.0), None)


def _gauss_sql() -> str:
    k = S.gaussian_kernel(5, 1.0)

    def one(source: str, axis: str, other: str) -> str:
        w = f"OVER (PARTITION BY image_id, {other} ORDER BY {axis})"
        cols = []
        for c in "rgb":
            total = " + ".join(f"coalesce(lag({c}, {2 - i}) {w} * {v!r}e0, 0e0)" for i, v in enumerate(k))
            weight = " + ".join(f"CASE WHEN lag({c}, {2 - i}) {w} IS NULL THEN 0e0 ELSE {v!r}e0 END" for i, v in enumerate(k))
            cols.append(f"{byte(f'({total}) / ({weight})')} AS {c}")
        return f"SELECT image_id, x, y, {', '.join(cols)}, a FROM {source}"

    return f", hz AS ({one('cv', 'x', 'y')}) {one('hz', 'y', 'x')}"


ORACLE_SQL["l12_gaussian_blur"] = f"WITH {X.CANVAS_SQL}{_gauss_sql()}"


# ------------------------------------------------------------------ resampling
def _area_sql(source: str, axis: str, other: str, size: int, new: int) -> str:
    s = f"({size} / {new}e0)"
    w = f"CAST(trunc((least((i + 1) * {s}, {axis} + 1) - greatest(i * {s}, {axis})) / {s} * 65536) AS BIGINT)"
    cols = ", ".join(f"{clamp(f'(CAST(sum({c} * {w}) AS BIGINT) + 32768) >> 16')} AS {c}" for c in "rgba")
    return f"SELECT image_id, CAST(i AS INT) AS {axis}, {other}, {cols} FROM {source}, (SELECT unnest(range(0, {new})) AS i) WHERE least((i + 1) * {s}, {axis} + 1) > greatest(i * {s}, {axis}) GROUP BY image_id, i, {other}"


on_rgba("r2_resample_down", lambda d: R.resample(d, (8, 2), (3, 1), "bspline"), f", hz AS ({_area_sql('px', 'x', 'y', 8, 3)}) {_area_sql('hz', 'y', 'x', 2, 1)}", OUT)


def _triangle_sql(source: str, axis: str, other: str, size: int, new: int, wrap_low: bool = False, wrap_high: bool = False) -> str:
    c0 = f"(i * ({size} / {new}e0))"
    taps = f"(SELECT i, j0, CASE WHEN j0 < 0 THEN {f'j0 + {size}' if wrap_low else '-j0'} WHEN j0 >= {size} THEN {f'j0 - {size}' if wrap_high else f'2 * {size} - j0 - 1'} ELSE j0 END AS j, CAST(trunc(greatest(0, 1 - abs(j0 - {c0})) * 65536) AS BIGINT) AS w FROM (SELECT unnest(range(0, {new})) AS i), (SELECT unnest(range(-1, {size} + 2)) AS j0) WHERE j0 BETWEEN CAST(trunc({c0} - 1) AS INT) AND CAST(ceil({c0} + 1) AS INT))"
    cols = ", ".join(f"{clamp(f'(CAST(sum({c} * w) AS BIGINT) + 32768) >> 16')} AS {c}" for c in "rgba")
    return f"SELECT image_id, CAST(i AS INT) AS {axis}, {other}, {cols} FROM {source} JOIN {taps} t ON t.j = {source}.{axis} WHERE w <> 0 GROUP BY image_id, i, {other}"


on_rgba("r7_resample_triangle", lambda d: R.resample(d, (8, 2), (13, 3), "triangle"), f", hz AS ({_triangle_sql('px', 'x', 'y', 8, 13)}) {_triangle_sql('hz', 'y', 'x', 2, 3)}", OUT)
on_rgba("r15_resample_wrapped", lambda d: R.resample(d, (8, 2), (13, 3), "triangle", ("wrap", "back", "wrap", "wrap")), f", hz AS ({_triangle_sql('px', 'x', 'y', 8, 13, True, True)}) {_triangle_sql('hz', 'y', 'x', 2, 3, False, True)}", OUT)
on_rgba("c4_resample_to_fit", lambda d: R.resample_to_fit(d, (8, 2), (16, 16), "fit", "triangle"), f", hz AS ({_triangle_sql('px', 'x', 'y', 8, 16)}) {_triangle_sql('hz', 'y', 'x', 2, 4)}", OUT)
on_rgba("r4_resample_box", lambda d: R.resample(d, (8, 2), (3, 1), "box"), f"SELECT image_id, CAST(i AS INT) AS x, y, {RGBA} FROM px, (SELECT unnest(range(0, 3)) AS i) WHERE y = 0 AND x = least(CAST(trunc(i * (8 / 3e0) + 0.5e0) AS INT), 7)", OUT)


def _table_sql(mode: str) -> str:
    """Weights are given; joining and summing are the engine's own."""

    def one(source: str, axis: str, other: str, size: int, new: int) -> str:
        values = ", ".join(str(t) for t in R.contributions(size, new, mode))
        cols = ", ".join(f"{clamp(f'(CAST(sum({c} * w) AS BIGINT) + 32768) >> 16')} AS {c}" for c in "rgba")
        return f"SELECT image_id, CAST(d AS INT) AS {axis}, {other}, {cols} FROM {source} JOIN (VALUES {values}) t(d, s, w) ON t.s = {source}.{axis} GROUP BY image_id, d, {other}"

    return f", hz AS ({one('px', 'x', 'y', 8, 11)}) {one('hz', 'y', 'x', 2, 5)}"


for _n, _mode in enumerate(("box", "hermite", "bell", "bspline", "mitchell", "lanczos3", "lanczos5", "lanczos7", "lanczos9", "lanczos11")):
    on_rgba(f"r{6 if _mode == 'box' else 13 if _mode.startswith('l') else 7 + _n}_resample_{_mode}_up", lambda d, mode=_mode: R.resample(d, (8, 2), (11, 5), mode), _table_sql(_mode), OUT)

# ------------------------------------------------------------------ analysis
add("h4_grayscale_histogram", lambda spark, d: A.histogram(P.grayscale(X.rgba(spark, d))).select("image_id", F.col("r").alias("v"), "count"), "SELECT image_id, CAST((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS INT) AS v, count(*) AS count FROM px GROUP BY ALL")
add("j1_histogram", lambda spark, d: A.ordered_histogram(X.rgba(spark, d), True), "SELECT r, g, b, a, count(*) AS count FROM px GROUP BY ALL")
add("j1_canvas_histogram", lambda spark, d: A.histogram(X.canvas(spark, d)), "SELECT image_id, r, g, b, a, count(*) AS count FROM cv GROUP BY ALL", X.CANVAS_SQL)
add("n1_content_size", lambda spark, d: A.content_size(X.rgba(spark, d), 1, 0, 6, 2, 128), "SELECT image_id, coalesce(max(CASE WHEN x BETWEEN 1 AND 6 AND a > 128 THEN x END), 0) AS content_width, coalesce(max(CASE WHEN x BETWEEN 1 AND 6 AND a > 128 THEN y + 1 END), 0) AS content_height FROM px GROUP BY image_id")
add("n3_rect_transparent", lambda spark, d: A.is_rect_transparent(X.rgba(spark, d), 2, 0, 2, 1, 100), "SELECT image_id, NOT bool_or(x BETWEEN 2 AND 3 AND y = 0 AND a > 100) AS transparent FROM px GROUP BY image_id")
add("n4_row_transparent", lambda spark, d: A.is_row_transparent(X.rgba(spark, d), 0, 1, 3, 100), "SELECT image_id, NOT bool_or(x BETWEEN 0 AND 2 AND y = 1 AND a > 100) AS transparent FROM px GROUP BY image_id")
add("n5_column_transparent", lambda spark, d: A.is_column_transparent(X.rgba(spark, d), 4, 0, 2, 100), "SELECT image_id, NOT bool_or(x = 4 AND a > 100) AS transparent FROM px GROUP BY image_id")
add("n6_is_grayscale", lambda spark, d: A.is_grayscale(X.rgba(spark, d)), "SELECT image_id, bool_and(r = g AND r = b) AS grayscale FROM px GROUP BY image_id")
add("n8_single_channel", lambda spark, d: A.single_channel(P.lookup(X.rgba(spark, d), {"g": [0] * 256, "b": [0] * 256})), "SELECT image_id, CASE WHEN bit_or(r) <> 0 THEN 'red' ELSE 'none' END AS channel FROM px GROUP BY image_id")
add("i18_hash", lambda spark, d: A.image_hash(X.rgba(spark, d)), """SELECT image_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(r + g * 256 + b * 65536 + a * CAST(16777216 AS BIGINT) AS BIGINT) ORDER BY y, x)), lambda h, p: (h * 65599 + p) % 4294967296) AS BIGINT) AS hash FROM px GROUP BY image_id""")

# ------------------------------------------------------------------ palettes
_PAL = palettes()["cga16"]
_VALUES = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(_PAL))
_INDEXED = ("image_id", "x", "y", "v")
on_rgba("v1_nearest", lambda d: Q.to_palette(d, _PAL), f", pal(i, pr, pg, pb) AS (VALUES {_VALUES}) SELECT image_id, x, y, CAST(arg_min(i, ((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)) * 256 + i) AS INT) AS v FROM px, pal GROUP BY image_id, x, y", _INDEXED)
_NEAR = "CAST(arg_min(i, ((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)) * 256 + i) AS INT)"
on_rgba("u12_nearest_without", lambda d: Q.to_palette(d, _PAL, exclude=(0, 7, 8)), f", pal(i, pr, pg, pb) AS (VALUES {_VALUES}) SELECT image_id, x, y, {_NEAR} AS v FROM px, pal WHERE i NOT IN (0, 7, 8) GROUP BY image_id, x, y", _INDEXED)
_WEB = palettes()["web_basic16"]
add("j6_to_other_palette", lambda spark, d: Q.to_other_palette(X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int")), _PAL, _WEB).select(*_INDEXED),
    f", c(v0, r, g, b) AS (VALUES {_VALUES}), pal(i, pr, pg, pb) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(_WEB))}), near AS (SELECT v0, {_NEAR} AS v FROM c, pal GROUP BY v0) SELECT image_id, x, y, near.v FROM gy JOIN near ON v0 = gy.v // 16", X.GRAY_SQL)
_BAYER = {2: [0, 3, 2, 1]}
_BAYER[4] = [0, 12, 3, 15, 8, 4, 11, 7, 2, 14, 1, 13, 10, 6, 9, 5]
_BAYER[8] = [0, 48, 12, 60, 3, 51, 15, 63, 32, 16, 44, 28, 35, 19, 47, 31, 8, 56, 4, 52, 11, 59, 7, 55, 40, 24, 36, 20, 43, 27, 39, 23, 2, 50, 14, 62, 1, 49, 13, 61, 34, 18, 46, 30, 33, 17, 45, 29, 10, 58, 6, 54, 9, 57, 5, 53, 42, 26, 38, 22, 41, 25, 37, 21]


def _wd(a: str, b: str) -> str:
    parts = [f"(({a}{c} - {b}{c}) * {w}e0)" for c, w in zip("rgb", ("0.299", "0.587", "0.114"), strict=True)]
    return " + ".join(f"{p} * {p}" for p in parts)


def _dither_sql(n: int) -> str:
    return f""", pal(i, pr, pg, pb) AS (VALUES {_VALUES}),
near AS (SELECT r, g, b, min(struct_pack(d := {_wd('', 'p')}, i := i)).i AS p FROM (SELECT DISTINCT r, g, b FROM px), pal GROUP BY r, g, b),
mir AS (SELECT near.*, pr, pg, pb, 2 * r - pr AS mr, 2 * g - pg AS mg, 2 * b - pb AS mb FROM near JOIN pal ON p = i),
alt AS (SELECT r, g, b, p, mir.pr, mir.pg, mir.pb, min(struct_pack(d := (mr - q.pr) * (mr - q.pr) * 299 + (mg - q.pg) * (mg - q.pg) * 587 + (mb - q.pb) * (mb - q.pb) * 114, i := q.i)).i AS q FROM mir JOIN pal q ON q.i <> p GROUP BY ALL),
plan AS (SELECT r, g, b, p, q, sqrt({_wd('', 'a.p')}) AS dp, sqrt({_wd('', 'z.p')}) AS dq FROM alt a JOIN pal z ON z.i = q)
SELECT image_id, x, y, CAST(CASE WHEN dp <> 0 AND CAST(trunc(dp / (dp + dq) * {n * n} + 0.5e0) AS INT) > list_extract({_BAYER[n]}, (y % {n}) * {n} + x % {n} + 1) THEN q ELSE p END AS INT) AS v FROM px JOIN plan USING (r, g, b)"""


for _n in (2, 4, 8):
    on_rgba(f"v{ {2: 2, 4: 3, 8: 4}[_n] }_ordered_{_n}x{_n}", lambda d, n=_n: Q.ordered_dither(d, _PAL, n), _dither_sql(_n), _INDEXED)


def _diffusion_sql(name: str) -> str:
    """One pixel of all images a step, errors kept as lists in raster order; a pixel takes one tap after the other."""
    divisor, taps = Q.DIFFUSION[name]
    whole = "floor" if divisor & (divisor - 1) == 0 else "trunc"
    step = "SELECT d.*, rs[k + 1] AS r, gs[k + 1] AS g, bs[k + 1] AS b FROM d JOIN im USING (image_id) WHERE k < 16"
    for dx, dy, weight in sorted(taps, key=lambda t: (-t[1], -t[0])):
        if dy < 2:  # the images have two lines
            share = {c: f"CAST({whole}(e{c}[k + 1 - {dx + 8 * dy}] * {weight} / {divisor}e0) AS INT)" for c in "rgb"}
            taken = ", ".join(f"CASE WHEN k % 8 - {dx} BETWEEN 0 AND 7 AND k // 8 >= {dy} THEN greatest(least({c} + {share[c]}, 255), 0) ELSE {c} END AS {c}" for c in "rgb")
            step = f"SELECT * REPLACE ({taken}) FROM ({step})"
    entries = ", ".join(f"{{'i': {i}, 'r': {r}, 'g': {g}, 'b': {b}}}" for i, (r, g, b) in enumerate(_PAL))
    distance = " + ".join(f"({c} - e.{c}) * ({c} - e.{c})" for c in "rgb")
    return f"""WITH RECURSIVE {X.RGBA_SQL}, im AS MATERIALIZED (SELECT image_id, {', '.join(f'list({c} ORDER BY y, x) AS {c}s' for c in 'rgb')} FROM px GROUP BY image_id),
d AS (SELECT image_id, 0 AS k, CAST([] AS INT[]) AS er, CAST([] AS INT[]) AS eg, CAST([] AS INT[]) AS eb, CAST([] AS INT[]) AS vs FROM im
UNION ALL SELECT image_id, k + 1, {', '.join(f'list_append(e{c}, {c} - pal[v + 1].{c})' for c in 'rgb')}, list_append(vs, v)
  FROM (SELECT *, CAST(list_min(list_transform(pal, lambda e: ({distance}) * 16 + e.i)) % 16 AS INT) AS v FROM (SELECT *, [{entries}] AS pal FROM ({step}))))
SELECT image_id, CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y, vs[k + 1] AS v FROM (SELECT image_id, vs, unnest(range(0, 16)) AS k FROM d WHERE k = 16)"""


def _quantize_sql(n: int) -> str:
    """Rows of (image, bucket, colour); each step splits one bucket of every image that has more than `n` colours."""
    group = "OVER (PARTITION BY image_id, bucket)"
    span = {c: f"max({c}) {group} - min({c}) {group}" for c in "rgb"}
    upto = "PARTITION BY image_id, bucket ORDER BY CASE channel WHEN 0 THEN r WHEN 1 THEN g ELSE b END, r, g, b"
    return f"""WITH RECURSIVE {X.RGBA_SQL}, co AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY image_id) AS kinds FROM (SELECT image_id, r, g, b, count(*) AS n FROM px GROUP BY ALL)),
cut AS (SELECT image_id, r, g, b, n, 0 AS bucket, 0 AS step FROM co WHERE kinds > {n}
UNION ALL SELECT image_id, r, g, b, n, CASE WHEN bucket <> chosen THEN bucket WHEN place = 1 OR (place < many AND 2 * before < total) THEN 2 * step + 1 ELSE 2 * step + 2 END, step + 1
  FROM (SELECT *, row_number() OVER ({upto}) AS place, count(*) {group} AS many, sum(n) {group} AS total, sum(n) OVER ({upto} ROWS UNBOUNDED PRECEDING) - n AS before
    FROM (SELECT *, first_value(bucket) OVER (PARTITION BY image_id ORDER BY greatest(sr, sg, sb) DESC, bucket) AS chosen, CASE WHEN sr >= sg AND sr >= sb THEN 0 WHEN sg >= sb THEN 1 ELSE 2 END AS channel
      FROM (SELECT *, {', '.join(f'{v} AS s{c}' for c, v in span.items())} FROM cut WHERE step < {n - 1})))),
mean AS (SELECT image_id, {', '.join(f'CAST(least(trunc(pow(avg(pow({c} / 255e0, 2.2e0)), 1 / 2.2e0) * 255 + 0.5e0), 255) AS INT) AS {c}' for c in 'rgb')} FROM cut WHERE step = {n - 1} GROUP BY image_id, bucket),
own AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS INT) AS idx, r, g, b FROM (SELECT DISTINCT * FROM mean UNION ALL SELECT image_id, r, g, b FROM co WHERE kinds <= {n}))"""


for _k, _name in enumerate(Q.DIFFUSION):
    on_rgba(f"v{6 + _k}_{_name}", lambda d, name=_name: Q.diffusion_dither(d, _PAL, name), None, _INDEXED)
    ORACLE_SQL[f"v{6 + _k}_{_name}"] = _diffusion_sql(_name)
on_rgba("j2_quantize", lambda d: Q.quantize(d, 8), None, ("image_id", "idx", "r", "g", "b", "a"))
ORACLE_SQL["j2_quantize"] = f"{_quantize_sql(8)} SELECT image_id, idx, r, g, b, 255 AS a FROM own"
on_rgba("j5_to_own_palette", lambda d: Q.to_own_palette(d, 8), None, _INDEXED)
ORACLE_SQL["j5_to_own_palette"] = f"{_quantize_sql(8)} SELECT image_id, px.x, px.y, arg_min(idx, ((px.r - own.r) ** 2 + (px.g - own.g) ** 2 + (px.b - own.b) ** 2) * 256 + idx) AS v FROM px JOIN own USING (image_id) GROUP BY ALL"

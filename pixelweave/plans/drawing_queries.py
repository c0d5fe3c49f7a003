"""Queries of the drawing operators, on the canvas of the events."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators import draw as D
from ..operators import shapes as S
from ..sources import fixtures as X
from .sqltext import over, over_pm

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
OUT = ("image_id", "x", "y", "r", "g", "b", "a")
INK = (250, 20, 60, 128)


def on_canvas(name: str, op: Callable, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: op(X.canvas(spark, d)).select(*OUT)
    if sql:
        ORACLE_SQL[name] = f"WITH {X.CANVAS_SQL} {sql}"


def painted(hit: str, color: dict[str, str] | tuple = (250, 20, 60, 128), source: str = "cv") -> str:
    if isinstance(color, tuple):
        color = {c: str(v) for c, v in zip("rgba", color, strict=True)}
    return f"SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN {hit} THEN {color[c]} ELSE {c} END AS INT) AS {c}' for c in 'rgba')} FROM {source}"


_P = {c: str(v) for c, v in zip("rgba", INK, strict=True)}
_U = {c: c for c in "rgba"}
_IN = "x BETWEEN -5 AND 24 AND y BETWEEN 3 AND 42"
on_canvas("k2_fill_rect", lambda d: D.fill_rect(d, (-5, 3, 30, 40), INK), painted(_IN))
on_canvas("k2_fill_rect_alpha", lambda d: D.fill_rect(d, (-5, 3, 30, 40), INK, "alpha"), painted(_IN, over(_P, _U, True)))
on_canvas("k2_fill_rect_alpha_pm", lambda d: D.fill_rect(d, (-5, 3, 30, 40), INK, "alpha_pm"), painted(_IN, over_pm(_P, _U) | {"a": "255"}))
on_canvas("k5_draw_rect", lambda d: D.draw_rect(d, (10, 5, 40, 20), INK, 3), painted("x BETWEEN 10 AND 49 AND y BETWEEN 5 AND 24 AND NOT (x BETWEEN 13 AND 46 AND y BETWEEN 8 AND 21)"))
_FX, _FY = f"((x - 10) * {65536 // 49})", f"((y - 5) * {65536 // 19})"
_CORNERS = ((255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (255, 255, 255, 255))
_GRAD = {c: f"((({_CORNERS[0][i]} * (65536 - {_FY}) + {_CORNERS[2][i]} * {_FY} + 32768) >> 16) * (65536 - {_FX}) + (({_CORNERS[1][i]} * (65536 - {_FY}) + {_CORNERS[3][i]} * {_FY} + 32768) >> 16) * {_FX} + 32768) >> 16" for i, c in enumerate("rgba")}
on_canvas("k3_gradient_rect", lambda d: D.fill_gradient_rect(d, (10, 5, 50, 20), *_CORNERS), painted("x BETWEEN 10 AND 59 AND y BETWEEN 5 AND 24", _GRAD))
on_canvas("k6_draw_line", lambda d: D.draw_line(d, (-10, 3), (90, 45), INK), painted("x BETWEEN -10 AND 90 AND y = 3 + CAST(floor((2 * (x + 10) * 42 + 100) / 200e0) AS INT)"))
on_canvas("k6_draw_line_steep", lambda d: D.draw_line(d, (60, 70), (40, -9), INK, skip_start=True), painted("y BETWEEN -9 AND 70 AND x = 60 - CAST(floor((2 * (70 - y) * 20 + 79) / 158e0) AS INT) AND NOT (x = 60 AND y = 70)"))
_STAR = ((50.0, 5.0), (65.0, 60.0), (20.0, 25.0), (80.0, 25.0), (35.0, 60.0))


def _polygon_sql(points) -> str:
    edges = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(points, [*points[1:], points[0]], strict=True))
    return f""", e(x1, y1, x2, y2) AS (VALUES {edges}),
cr AS (SELECT l, floor(x1 + (l + 0.5e0 - y1) * (x2 - x1) / (y2 - y1) + 0.5e0) AS cx FROM e, (SELECT unnest(range(0, 200)) AS l) WHERE least(y1, y2) <= l + 0.5e0 AND l + 0.5e0 < greatest(y1, y2)),
rk AS (SELECT l, cx, row_number() OVER (PARTITION BY l ORDER BY cx) AS k, lead(cx) OVER (PARTITION BY l ORDER BY cx) AS ex FROM cr),
hit AS (SELECT DISTINCT cv.x, cv.y FROM cv JOIN rk ON cv.y = l AND cv.x BETWEEN cx AND ex AND k % 2 = 1),
cw AS (SELECT cv.*, hit.x IS NOT NULL AS hit FROM cv LEFT JOIN hit USING (x, y)) {painted('hit', source='cw')}"""


on_canvas("k10_fill_polygon", lambda d: D.fill_polygon(d, _STAR, INK), None)
ORACLE_SQL["k10_fill_polygon"] = f"WITH {X.CANVAS_SQL}{_polygon_sql(_STAR)}"


def _polygons(spark, d):
    """A triangle of every fifth supplier, drawn from a relation of vertices."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    corner = lambda i, dx, dy: F.struct(F.lit(i).alias("seq"), (F.col("k") * 7 % 90 + dx).cast("double").alias("x"), (F.col("k") * 3 % 80 + dy).cast("double").alias("y"))
    v = s.select(F.lit(0).cast("long").alias("image_id"), F.col("k").alias("poly_id"), F.explode(F.array(corner(0, 0.0, 0.0), corner(1, 9.0, 2.5), corner(2, 3.0, 8.0))).alias("v")).select("image_id", "poly_id", "v.*")
    return D.fill_polygons(X.canvas(spark, d), v, INK).select(*OUT)


QUERIES["k10_fill_polygons"] = _polygons
ORACLE_SQL["k10_fill_polygons"] = f"""WITH {X.CANVAS_SQL}, s AS (SELECT s_suppkey AS k, s_suppkey * 7 % 90 AS ox, s_suppkey * 3 % 80 AS oy FROM supplier),
e AS (SELECT k, ox + a AS x1, oy + b AS y1, ox + c AS x2, oy + f AS y2 FROM s, (VALUES (0e0, 0e0, 9e0, 2.5e0), (9e0, 2.5e0, 3e0, 8e0), (3e0, 8e0, 0e0, 0e0)) AS t(a, b, c, f)),
cr AS (SELECT k, l, floor(x1 + (l + 0.5e0 - y1) * (x2 - x1) / (y2 - y1) + 0.5e0) AS cx FROM e, (SELECT unnest(range(0, 100)) AS l) WHERE least(y1, y2) <= l + 0.5e0 AND l + 0.5e0 < greatest(y1, y2)),
rk AS (SELECT k, l, cx, row_number() OVER (PARTITION BY k, l ORDER BY cx) AS n, lead(cx) OVER (PARTITION BY k, l ORDER BY cx) AS ex FROM cr),
hit AS (SELECT DISTINCT cv.x, cv.y FROM cv JOIN rk ON cv.y = l AND cv.x BETWEEN cx AND ex AND n % 2 = 1),
cw AS (SELECT cv.*, hit.x IS NOT NULL AS hit FROM cv LEFT JOIN hit USING (x, y)) {painted('hit', source='cw')}"""

on_canvas("k9_thick_line", lambda d: D.draw_thick_line(d, (10, 10), (70, 40), 5.0, INK), None)
_NX, _NY = -(30.0) / (30.0**2 + 60.0**2) ** 0.5 * 2.5, 60.0 / (30.0**2 + 60.0**2) ** 0.5 * 2.5
ORACLE_SQL["k9_thick_line"] = f"WITH {X.CANVAS_SQL}" + _polygon_sql(((10.5 + _NX, 10.5 + _NY), (70.5 + _NX, 40.5 + _NY), (70.5 - _NX, 40.5 - _NY), (10.5 - _NX, 10.5 - _NY)))
_CURVE = ((5, 5), (30, 90), (60, -40), (95, 50))
on_canvas("k12_draw_bezier", lambda d: D.draw_bezier(d, *_CURVE, INK), None)
_STEPS = max(int(sum(math.dist(a, b) for a, b in zip(_CURVE, _CURVE[1:], strict=False)) * 0.25), 20)
_AT = [f"CAST(trunc((1 - t) ** 3 * {a[k]} + 3 * t * (1 - t) ** 2 * {b[k]} + 3 * t * t * (1 - t) * {c[k]} + t ** 3 * {e[k]} + 0.5e0) AS INT)" for k in (0, 1) for a, b, c, e in [_CURVE]]
ORACLE_SQL["k12_draw_bezier"] = f"""WITH {X.CANVAS_SQL}, co AS (SELECT i, {_AT[0]} AS x1, {_AT[1]} AS y1 FROM (SELECT i, i / {_STEPS}e0 AS t FROM (SELECT unnest(range(0, {_STEPS + 1})) AS i))),
seg AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, greatest(abs(x2 - x1), abs(y2 - y1)) AS major FROM (SELECT *, lead(x1) OVER (ORDER BY i) AS x2, lead(y1) OVER (ORDER BY i) AS y2 FROM co) WHERE x2 IS NOT NULL),
st AS (SELECT *, unnest(range(1, major + 1)) AS s FROM seg WHERE major > 0),
hit AS (SELECT DISTINCT x, y FROM (SELECT x1 + sign(dx) * ((2 * s * abs(dx) + major) // (2 * major)) AS x, y1 + sign(dy) * ((2 * s * abs(dy) + major) // (2 * major)) AS y FROM st UNION ALL SELECT x1, y1 FROM co WHERE i = 0)),
cw AS (SELECT cv.*, hit.x IS NOT NULL AS hit FROM cv LEFT JOIN hit USING (x, y)) {painted('hit', source='cw')}"""


def _shapes(spark, d):
    """A rectangle, a line, a frame or a curve of each customer, in every mode, painted in the order of the keys."""
    k = F.col("c_custkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = k * 7 % 110 - 5, k * 13 % 105 - 3, k % 23 + 1, k % 17 + 1
    kind = F.element_at(F.array(*map(F.lit, ("rect", "line", "frame", "curve"))), (k % 4 + 1).cast("int"))
    points = F.when(k % 4 == 1, F.array(at(x, y), at(x + w * 2 - 20, y + h * 3 - 25))).when(k % 4 == 3, F.array(at(x, y), at(x + w, y - h), at(x - h, y + w), at(x + h, y + h))).otherwise(F.array(at(x, y), at(w, h)))
    color = F.struct(*[(k * m % 256).cast("int").alias(c) for c, m in zip("rgb", (3, 5, 11), strict=True)], (F.floor(k / 3) * 50 % 300).cast("int").alias("a"))
    color = F.struct(*[color[c].alias(c) for c in "rgb"], F.least(color["a"], F.lit(255)).alias("a"))
    mode = F.element_at(F.array(*map(F.lit, S.MODES)), (F.floor(k / 4) % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(
        F.lit(0).cast("long").alias("image_id"), k.alias("ord"), kind.alias("kind"), points.alias("points"), F.lit(20).alias("n"), F.lit(2).alias("thickness"), (k % 8 == 1).alias("skip_start"), mode.alias("mode"), F.array(color).alias("colors")
    )
    return S.paint(X.canvas(spark, d), rows).select(*OUT)


QUERIES["k2_painted_in_order"] = _shapes
_BLEND = {m: f({c: f"s.{c}" for c in "rgba"}, {c: f"u.{c}" for c in "rgba"}) for m, f in (("alpha", lambda o, u: over(o, u, True)), ("alpha_pm", lambda o, u: over_pm(o, u) | {"a": "255"}))}
_FOLD = ", ".join(f"{c} := CAST(CASE WHEN s.mode = 'copy' OR s.a = 255 THEN s.{c} WHEN s.mode = 'transparent' THEN CASE WHEN s.a <> 0 THEN s.{c} ELSE u.{c} END WHEN s.mode = 'alpha' THEN {_BLEND['alpha'][c]} ELSE {_BLEND['alpha_pm'][c]} END AS INT)" for c in "rgba")
_BEZ = [f"CAST(trunc((1 - t) * (1 - t) * (1 - t) * {a} + 3 * t * (1 - t) * (1 - t) * {b} + 3 * t * t * (1 - t) * {c} + t * t * t * {e} + 0.5e0) AS BIGINT)" for a, b, c, e in (("x", "(x + w)", "(x - h)", "(x + h)"), ("y", "(y - h)", "(y + w)", "(y + h)"))]
ORACLE_SQL["k2_painted_in_order"] = f"""WITH {X.CANVAS_SQL},
sh AS MATERIALIZED (SELECT *, least(k // 3 * 50 % 300, 255) AS a, ['copy', 'transparent', 'alpha', 'alpha_pm'][k // 4 % 4 + 1] AS mode FROM (
  SELECT c_custkey AS k, c_custkey * 7 % 110 - 5 AS x, c_custkey * 13 % 105 - 3 AS y, c_custkey % 23 + 1 AS w, c_custkey % 17 + 1 AS h, c_custkey * 3 % 256 AS r, c_custkey * 5 % 256 AS g, c_custkey * 11 % 256 AS b FROM customer)),
boxes AS (SELECT k, px, unnest(range(y, y + h)) AS py, x, y, w, h FROM (SELECT *, unnest(range(x, x + w)) AS px FROM sh WHERE k % 2 = 0)),
legs AS (
  SELECT k, x AS x1, y AS y1, x + w * 2 - 20 AS x2, y + h * 3 - 25 AS y2, CASE WHEN k % 8 = 1 THEN 1 ELSE 0 END AS s0 FROM sh WHERE k % 4 = 1
  UNION ALL SELECT k, coalesce(lag(cx) OVER w, cx), coalesce(lag(cy) OVER w, cy), cx, cy, CASE WHEN i = 0 THEN 0 ELSE 1 END
  FROM (SELECT k, i, {_BEZ[0]} AS cx, {_BEZ[1]} AS cy FROM (SELECT *, i / 20e0 AS t FROM (SELECT *, unnest(range(0, 21)) AS i FROM sh WHERE k % 4 = 3))) WINDOW w AS (PARTITION BY k ORDER BY i)),
walk AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1)) AS major, unnest(range(s0, greatest(abs(x2 - x1), abs(y2 - y1)) + 1)) AS s FROM legs),
dots AS (SELECT DISTINCT k, px, py FROM (
  SELECT k, px, py FROM boxes WHERE k % 4 = 0 OR 4 >= least(w, h) OR NOT (px BETWEEN x + 2 AND x + w - 3 AND py BETWEEN y + 2 AND y + h - 3)
  UNION ALL SELECT k, CASE WHEN major = 0 THEN x1 ELSE x1 + sign(x2 - x1) * ((2 * s * abs(x2 - x1) + major) // (2 * major)) END, CASE WHEN major = 0 THEN y1 ELSE y1 + sign(y2 - y1) * ((2 * s * abs(y2 - y1) + major) // (2 * major)) END FROM walk)),
stack AS (SELECT px, py, list(struct_pack(mode := mode, r := CAST(r AS INT), g := CAST(g AS INT), b := CAST(b AS INT), a := CAST(a AS INT)) ORDER BY k) AS marks FROM dots JOIN sh USING (k) GROUP BY px, py),
done AS (SELECT cv.*, list_reduce(list_prepend(struct_pack(mode := 'copy', r := cv.r, g := cv.g, b := cv.b, a := cv.a), coalesce(marks, [])), lambda u, s: struct_pack(mode := 'copy', {_FOLD})) AS p FROM cv LEFT JOIN stack ON px = x AND py = y)
SELECT image_id, x, y, p.r AS r, p.g AS g, p.b AS b, p.a AS a FROM done"""

"""Queries of colour scalars, colour text and rectangles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import rects as T
from ..functions.named import named_colors
from ..sources import fixtures as X
from .sqltext import byte, d255, over, over_pm

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def scalar(name: str, channels: Callable, sql: dict[str, str]) -> None:
    """Colours of one pixel and the next one in its row."""

    def run(spark, d):
        px = X.rgba(spark, d)
        two = px.join(px.select("image_id", (F.col("x") - 1).alias("x"), "y", *[F.col(c).alias(f"s_{c}") for c in "rgba"]), ["image_id", "x", "y"])
        out = channels(K.columns(), K.columns("s_"))
        return two.select("image_id", "x", "y", *[v.alias(k) for k, v in out.items()])

    QUERIES[name] = run
    cols = ", ".join(f"{v} AS {k}" for k, v in sql.items())
    ORACLE_SQL[name] = f"WITH {X.RGBA_SQL} SELECT d.image_id, d.x, d.y, {cols} FROM px d JOIN px s ON s.image_id = d.image_id AND s.x = d.x + 1 AND s.y = d.y"


def _int(c: dict[str, str]) -> dict[str, str]:
    return {k: f"CAST({v} AS INT)" for k, v in c.items()}


_D, _S = {c: f"d.{c}" for c in "rgba"}, {c: f"s.{c}" for c in "rgba"}
scalar("p3_unit_channels", lambda d, s: {"rf": d["r"] / 255.0, "gf": d["g"] / 255.0, "bf": d["b"] / 255.0, "af": d["a"] / 255.0}, {f"{c}f": f"d.{c} / 255e0" for c in "rgba"})
scalar("p10_channel_by_ordinal", lambda d, s: {f"c{i}": F.element_at(F.array(*[d[c] for c in "rgba"]), F.lit(i + 1)) for i in range(4)}, {f"c{i}": f"d.{c}" for i, c in enumerate("rgba")})
_SETTERS = {"max_r": {"r": 255}, "max_g": {"g": 255}, "max_b": {"b": 255}, "max_a": {"a": 255}, "opaque": {"a": 255}, "zero_r": {"r": 0}, "zero_g": {"g": 0}, "zero_b": {"b": 0}, "zero_a": {"a": 0}}
scalar("p17_channel_setters", lambda d, s: {n: K.packed(K.with_channel(d, **v)) for n, v in _SETTERS.items()},
       {n: " + ".join(f"CAST({v.get(c, f'd.{c}')} AS BIGINT) * {256**i}" for i, c in enumerate("rgba")) for n, v in _SETTERS.items()})
scalar("p26_merge", K.merge, _int({c: f"(d.{c} + s.{c}) >> 1" for c in "rgba"}))
scalar("p27_mix", lambda d, s: K.mix(d, s, 0.3), _int({c: f"(d.{c} * 45876 + s.{c} * 19660 + 32768) >> 16" for c in "rgba"}))
scalar("p28_premultiply", lambda d, s: {k: v.cast("int") for k, v in K.premultiply(d).items()}, _int({c: f"CASE WHEN d.a >= 255 THEN d.{c} ELSE {d255(f'd.{c} * d.a')} END" for c in "rgb"} | {"a": "d.a"}))
scalar("p29_unpremultiply", lambda d, s: K.unpremultiply(d), _int({c: f"CASE WHEN d.a = 0 THEN 0 ELSE least((d.{c} * (1095216660480 // nullif(d.a, 0))) >> 32, 255) END" for c in "rgb"} | {"a": "d.a"}))
scalar("p30_scale", lambda d, s: {k: v.cast("int") for k, v in K.scale(d, s).items()}, _int({c: d255(f"d.{c} * s.{c} + 128") for c in "rgba"}))
scalar("p32_over", lambda d, s: K.over(s, d), _int(over(_S, _D)))
scalar("p33_over_opaque", lambda d, s: K.over(s, d, True), _int(over(_S, _D, True)))
scalar("p34_over_pm", lambda d, s: K.over_pm(s, d), _int(over_pm(_S, _D)))
scalar("p36_black_over", lambda d, s: K.black_over(s["a"], d), _int(over({"r": "0", "g": "0", "b": "0", "a": "s.a"}, _D)))
scalar("p38_white_over", lambda d, s: K.white_over(s["a"], d), _int(over({"r": "255", "g": "255", "b": "255", "a": "s.a"}, _D)))
scalar("p50_gamma", lambda d, s: K.gamma(d, 2.2), _int({c: byte(f"pow(d.{c} / 255e0, 2.2e0) * 255") for c in "rgb"} | {"a": "d.a"}))
scalar("p64_hash", lambda d, s: {"hash": K.hash32(d)}, {"hash": "((((CAST(d.a AS BIGINT) * 65599 + d.b) % 4294967296) * 65599 + d.g) % 4294967296 * 65599 + d.r) % 4294967296"})
scalar("p65_distances", lambda d, s: {"squared": K.distance_squared(d, s), "distance": F.sqrt(K.distance_squared(d, s).cast("double")), "weighted": K.weighted_distance_squared(d, s)},
       {"squared": "(d.r - s.r) * (d.r - s.r) + (d.g - s.g) * (d.g - s.g) + (d.b - s.b) * (d.b - s.b)", "distance": "sqrt((d.r - s.r) * (d.r - s.r) + (d.g - s.g) * (d.g - s.g) + (d.b - s.b) * (d.b - s.b))",
        "weighted": " + ".join(f"((d.{c} - s.{c}) * {w}e0) * ((d.{c} - s.{c}) * {w}e0)" for c, w in zip("rgb", ("0.299", "0.587", "0.114"), strict=True))})
scalar("p61_equal", lambda d, s: {"equal": F.struct(*d.values()) == F.struct(*s.values()), "same_rgb": K.distance_squared(d, s) == 0}, {"equal": "d.r = s.r AND d.g = s.g AND d.b = s.b AND d.a = s.a", "same_rgb": "d.r = s.r AND d.g = s.g AND d.b = s.b"})
_HEX = "'#' || printf('%02x%02x%02x', d.r, d.g, d.b)"
_ALPHA = "regexp_replace(printf('%.3f', floor(d.a * 1000e0 / 255e0 + 0.5e0) / 1000e0), '\\.?0+$', '')"
scalar("p11_color_text", lambda d, s: {"hex6": K.hex6(d), "hex8": K.hex8(d), "hex": K.hex_text(d), "rgb": K.rgb_text(d), "vector": K.vector_text(d)},
       {"hex6": _HEX, "hex8": f"{_HEX} || printf('%02x', d.a)", "hex": f"CASE WHEN d.a < 255 THEN {_HEX} || printf('%02x', d.a) ELSE {_HEX} END",
        "rgb": f"CASE WHEN d.a < 255 THEN 'rgba(' || d.r || ',' || d.g || ',' || d.b || ',' || {_ALPHA} || ')' ELSE 'rgb(' || d.r || ',' || d.g || ',' || d.b || ')' END", "vector": "'(' || d.r || ', ' || d.g || ', ' || d.b || ', ' || d.a || ')'"})
_MX, _MN = "(greatest(d.r, d.g, d.b) / 255e0)", "(least(d.r, d.g, d.b) / 255e0)"
_H0 = f"60 * CASE WHEN d.r = greatest(d.r, d.g, d.b) THEN (d.g / 255e0 - d.b / 255e0) / ({_MX} - {_MN}) WHEN d.g = greatest(d.r, d.g, d.b) THEN (d.b / 255e0 - d.r / 255e0) / ({_MX} - {_MN}) + 2 ELSE (d.r / 255e0 - d.g / 255e0) / ({_MX} - {_MN}) + 4 END"


def _round6(v):
    return F.floor(v * 1e6 + 0.5) / 1e6


def _hue_out(d, s):
    h, sb, v = K.to_hsb(d)
    _, sl, light = K.to_hsl(d)
    return {"hue": _round6(h), "sat_b": _round6(sb), "brightness": _round6(v), "sat_l": _round6(sl), "lightness": _round6(light)}


scalar("p45_hue", _hue_out, {
    "hue": f"CASE WHEN {_MX} = {_MN} THEN 0 ELSE floor((({_H0}) + CASE WHEN ({_H0}) < 0 THEN 360 ELSE 0 END) * 1e6 + 0.5e0) / 1e6 END",
    "sat_b": f"CASE WHEN {_MX} = 0 THEN 0 ELSE floor(({_MX} - {_MN}) / {_MX} * 1e6 + 0.5e0) / 1e6 END", "brightness": f"floor({_MX} * 1e6 + 0.5e0) / 1e6",
    "sat_l": f"CASE WHEN {_MX} = {_MN} THEN 0 ELSE floor(({_MX} - {_MN}) / (1 - abs(2 * (({_MX} + {_MN}) / 2) - 1)) * 1e6 + 0.5e0) / 1e6 END", "lightness": f"floor(({_MX} + {_MN}) / 2 * 1e6 + 0.5e0) / 1e6"})


def _hue_round_trip(spark, d):
    """Colours through HSB and HSL and back."""
    px = X.rgba(spark, d)
    out = px
    for to, back, tag in ((K.to_hsb, K.with_hsb, "hsb"), (K.to_hsl, K.with_hsl, "hsl")):
        h, s, v = to(K.columns())
        out = back(out.withColumns({"__h": h, "__s": s, "__v": v}), "__h", "__s", "__v").withColumnsRenamed({f"__{c}": f"{tag}_{c}" for c in "rgb"}).drop("__h", "__s", "__v")
    return out.select("image_id", "x", "y", *[f"{t}_{c}" for t in ("hsb", "hsl") for c in "rgb"])


QUERIES["p48_hue_round_trip"] = _hue_round_trip
ORACLE_SQL["p48_hue_round_trip"] = f"WITH {X.RGBA_SQL} SELECT image_id, x, y, {', '.join(f'{c} AS {t}_{c}' for t in ('hsb', 'hsl') for c in 'rgb')} FROM px"


# ------------------------------------------------------------------ parsing
def _texts(spark, d):
    """Colour texts of events: hex of 3, 4, 6 and 8 digits, rgb() and rgba(), names in mixed case, invalid."""
    names = F.array(*[F.lit(n) for _, n, *_ in named_colors()])
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    k, h = F.col("event_id"), F.lower(F.lpad(F.hex(F.pmod(F.col("event_id") * 2_654_435_761, F.lit(1 << 32))), 8, "0"))
    n = lambda v: F.pmod(v, F.lit(300)).cast("string")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("#"), F.substring(h, 1, 3))).when(k % 8 == 1, F.concat(F.lit("#"), F.upper(F.substring(h, 1, 4)))).when(k % 8 == 2, F.concat(F.lit("#"), F.substring(h, 1, 6)))
        .when(k % 8 == 3, F.concat(F.lit("#"), h)).when(k % 8 == 4, F.concat(F.lit("rgb("), n(k), F.lit(", "), n(k * 7), F.lit(","), n(k * 11), F.lit(")")))
        .when(k % 8 == 5, F.concat(F.lit("RGBA("), n(k), F.lit(","), n(k * 7), F.lit(","), n(k * 11), F.lit(",0."), F.pmod(k, F.lit(1000)).cast("string"), F.lit(")")))
        .when(k % 8 == 6, F.initcap(F.element_at(names, (F.pmod(F.floor(k / 8), F.lit(148)) + 1).cast("int")))).otherwise(F.concat(F.lit("#"), F.substring(h, 1, 5)))
    )
    return e.select("event_id", text.alias("text"))


def _parse(spark, d):
    table = spark.createDataFrame([(n, r, g, b, a) for _, n, r, g, b, a in named_colors()], "name string, nr int, ng int, nb int, na int")
    t = _texts(spark, d).withColumn("name", F.lower(F.trim("text")))
    j = t.join(F.broadcast(table), "name", "left")  # 148 rows
    p = F.coalesce(K.parse_hex(F.col("text")), K.parse_rgb(F.col("text")))
    return j.withColumn("p", p).select("event_id", "text", *[F.coalesce(F.col(f"p.{c}"), F.col(f"n{c}")).cast("int").alias(c) for c in "rgba"])


_NAMED = ", ".join(f"('{n}', {r}, {g}, {b}, {a})" for _, n, r, g, b, a in named_colors())
_LIST = "[" + ", ".join(f"'{n}'" for _, n, *_ in named_colors()) + "]"
QUERIES["p73_parse_color"] = _parse
ORACLE_SQL["p73_parse_color"] = f"""WITH h AS (SELECT event_id AS k, event_id, printf('%08x', (event_id * 2654435761) % 4294967296) AS h FROM events),
t AS (SELECT *, CASE k % 8 WHEN 0 THEN '#' || h[1:3] WHEN 1 THEN '#' || upper(h[1:4]) WHEN 2 THEN '#' || h[1:6] WHEN 3 THEN '#' || h
  WHEN 4 THEN 'rgb(' || k % 300 || ', ' || k * 7 % 300 || ',' || k * 11 % 300 || ')' WHEN 5 THEN 'RGBA(' || k % 300 || ',' || k * 7 % 300 || ',' || k * 11 % 300 || ',0.' || k % 1000 || ')'
  WHEN 6 THEN (SELECT upper(n[1:1]) || n[2:] FROM (SELECT {_LIST}[CAST(k // 8 % 148 AS INT) + 1] AS n)) ELSE '#' || h[1:5] END AS text FROM h),
n(name, nr, ng, nb, na) AS (VALUES {_NAMED}),
w AS (SELECT *, CASE WHEN k % 8 < 2 THEN regexp_replace(lower(text[2:]), '(.)', '\\1\\1', 'g') ELSE lower(text[2:]) END AS x FROM t)
SELECT event_id, text,
  {', '.join(f"CAST(CASE WHEN k % 8 < 4 THEN CAST('0x' || x[{2 * i + 1}:{2 * i + 2}] AS INT) WHEN k % 8 < 6 THEN least(k * {m} % 300, 255) ELSE n{c} END AS INT) AS {c}" for i, (c, m) in enumerate((('r', 1), ('g', 7), ('b', 11))))},
  CAST(CASE WHEN k % 8 IN (0, 2, 4) THEN 255 WHEN k % 8 IN (1, 3) THEN CAST('0x' || x[7:8] AS INT) WHEN k % 8 = 5 THEN trunc(CAST('0.' || k % 1000 AS DOUBLE) * 255 + 0.5e0) ELSE na END AS INT) AS a
FROM w LEFT JOIN n ON n.name = lower(text)"""


def _name_of(spark, d):
    """Name of a colour if it has one (the first in the list), else its hex text."""
    rows = {}
    for _, n, r, g, b, a in named_colors():
        rows.setdefault((r, g, b, a), n)
    table = spark.createDataFrame([(*c, n) for c, n in rows.items()], "r int, g int, b int, a int, name string")
    colors = _parse(spark, d).where("r IS NOT NULL").select("event_id", "r", "g", "b", "a")
    return colors.join(F.broadcast(table), list("rgba"), "left").select("event_id", F.coalesce("name", K.hex_text(K.columns())).alias("said"))


QUERIES["p13_to_string"] = _name_of
ORACLE_SQL["p13_to_string"] = f"""WITH parsed AS ({ORACLE_SQL['p73_parse_color']}), n(i, name, r, g, b, a) AS (VALUES {', '.join(f"({i}, '{n}', {r}, {g}, {b}, {a})" for i, n, r, g, b, a in named_colors())}),
f AS (SELECT r, g, b, a, arg_min(name, i) AS name FROM n GROUP BY ALL)
SELECT event_id, coalesce(name, '#' || printf('%02x%02x%02x', r, g, b) || CASE WHEN a < 255 THEN printf('%02x', a) ELSE '' END) AS said FROM parsed LEFT JOIN f USING (r, g, b, a) WHERE r IS NOT NULL"""


# ------------------------------------------------------------------ rectangles
def rects(name: str, outputs: Callable, sql: str) -> None:
    def run(spark, d):
        return X.rectangles(spark, d).select("rect_id", *[v.cast("string").alias(k) if k == "text" else v.cast("int").alias(k) for k, v in outputs(T.rect()).items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {X.RECTS_SQL} SELECT rect_id, {sql} FROM rc"


def _named(prefix: str, r: dict) -> dict:
    return {f"{prefix}_{k}": v for k, v in r.items()}


rects("q1_edges", lambda r: {"l": r["x"], "rr": T.right(r), "t": r["y"], "bb": T.bottom(r), "cx": T.center(r)[0], "cy": T.center(r)[1], "text": T.text(r)}, "x AS l, x + w AS rr, y AS t, y + h AS bb, x + w // 2 AS cx, y + h // 2 AS cy, '(' || x || ', ' || y || ') [' || w || 'x' || h || ']' AS text")
rects("q14_grow_offset_scale", lambda r: _named("g", T.grow(r, 2, 3)) | _named("o", T.offset(r, 5, -4)) | _named("k", T.resized(r, 3)) | _named("d", T.shrunk(r, 2)) | _named("e", T.from_edges(T.right(r), r["y"], r["x"] + 100, T.bottom(r))),
      "x - 2 AS g_x, y - 3 AS g_y, w + 4 AS g_w, h + 6 AS g_h, x + 5 AS o_x, y - 4 AS o_y, w AS o_w, h AS o_h, x AS k_x, y AS k_y, w * 3 AS k_w, h * 3 AS k_h, x AS d_x, y AS d_y, w // 2 AS d_w, h // 2 AS d_h, x + w AS e_x, y AS e_y, 100 - w AS e_w, h AS e_h")
rects("q15_add_sub", lambda r: _named("p", T.add(r, T.transposed(r))) | _named("m", T.add(r, T.of(3, -2, 1, 5), -1)),
      "x + y AS p_x, y + x AS p_y, w + h AS p_w, h + w AS p_h, x - 3 AS m_x, y + 2 AS m_y, w - 1 AS m_w, h - 5 AS m_h")
rects("q19_equal_hash", lambda r: {"same": T.equal(r, T.transposed(r)), "differs": ~T.equal(r, T.transposed(r)), "hash": T.hash32(r)},
      "CAST(x = y AND w = h AS INT) AS same, CAST(NOT (x = y AND w = h) AS INT) AS differs, CAST((((((x * CAST(65599 AS HUGEINT) + y) * 65599 + w) * 65599 + h) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 AS INT) AS hash")
rects("q24_clip_flip", lambda r: _named("c", T.clip(r, 40, 30)) | _named("t", T.transposed(r)) | {"fx": T.flipped_horz(r, 20)["x"], "fy": T.flipped_vert(r, 20)["y"]} | _named("s", T.scaled(T.offset(r, 3, 3), 1.5)),
      "greatest(x, 0) AS c_x, greatest(y, 0) AS c_y, least(x + w, 40) - greatest(x, 0) AS c_w, least(y + h, 30) - greatest(y, 0) AS c_h, y AS t_x, x AS t_y, h AS t_w, w AS t_h, 40 - x - w AS fx, 40 - y - h AS fy, CAST(trunc((x + 3) * 1.5e0 + 0.5e0) AS INT) AS s_x, CAST(trunc((y + 3) * 1.5e0 + 0.5e0) AS INT) AS s_y, CAST(trunc(w * 1.5e0 + 0.5e0) AS INT) AS s_w, CAST(trunc(h * 1.5e0 + 0.5e0) AS INT) AS s_h")


def _pairs(spark, d):
    """Rectangles of parts against those of orders. Equal rectangles meet as one; their keys are written out last, all parts of
    an order's rectangle in turn, so that neighbouring rows differ in one column and files of all the pairs stay small. Cells are
    as large as orders' rectangles in the mean."""
    a = X.rectangles(spark, d)
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") * 13 % 90).cast("int").alias("x"), (F.col("p_partkey") * 29 % 90).cast("int").alias("y"), (F.col("p_size") % 9 + 1).cast("int").alias("w"), (F.col("p_size") % 5 + 1).cast("int").alias("h"))
    mean = a.agg(F.avg(F.greatest("w", "h"))).first()[0] or 1.0
    joined = T.intersecting(T.listed(a, "rect_id"), T.listed(p, "part"), max(2, int(mean + 0.5)))
    r, s = T.rect(), T.rect("s_")
    met = joined.select("keys", "s_keys", *[v.cast("int").alias(f"i_{k}") for k, v in T.intersect(r, s).items()], *[v.cast("int").alias(f"u_{k}") for k, v in T.union(r, s).items()], T.contains(r, s).alias("inside"))
    return T.paired(met, "rect_id", "part")


QUERIES["q23_intersecting_pairs"] = _pairs
ORACLE_SQL["q23_intersecting_pairs"] = f"""WITH {X.RECTS_SQL}, p AS (SELECT p_partkey AS part, CAST(p_partkey * 13 % 90 AS INT) AS x, CAST(p_partkey * 29 % 90 AS INT) AS y, CAST(p_size % 9 + 1 AS INT) AS w, CAST(p_size % 5 + 1 AS INT) AS h FROM part)
SELECT rect_id, part, greatest(r.x, s.x) AS i_x, greatest(r.y, s.y) AS i_y, least(r.x + r.w, s.x + s.w) - greatest(r.x, s.x) AS i_w, least(r.y + r.h, s.y + s.h) - greatest(r.y, s.y) AS i_h,
  least(r.x, s.x) AS u_x, least(r.y, s.y) AS u_y, greatest(r.x + r.w, s.x + s.w) - least(r.x, s.x) AS u_w, greatest(r.y + r.h, s.y + s.h) - least(r.y, s.y) AS u_h,
  s.x >= r.x AND s.y >= r.y AND s.x + s.w <= r.x + r.w AND s.y + s.h <= r.y + r.h AS inside
FROM rc r JOIN p s ON r.x < s.x + s.w AND s.x < r.x + r.w AND r.y < s.y + s.h AND s.y < r.y + r.h"""
QUERIES["q29_bounding_box"] = lambda spark, d: X.rectangles(spark, d).groupBy((F.col("rect_id") % 16).alias("part")).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))
ORACLE_SQL["q29_bounding_box"] = f"WITH {X.RECTS_SQL} SELECT rect_id % 16 AS part, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rc GROUP BY 1"
QUERIES["q13_points_in_rects"] = lambda spark, d: X.canvas(spark, d).groupBy(T.contains_point(T.of(10, 20, 30, 40), F.col("x"), F.col("y")).alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("red"))
ORACLE_SQL["q13_points_in_rects"] = f"WITH {X.CANVAS_SQL} SELECT x >= 10 AND y >= 20 AND x < 40 AND y < 60 AS inside, count(*) AS n, CAST(sum(r) AS BIGINT) AS red FROM cv GROUP BY 1"

"""Queries of resizing and resampling on tables of images of several sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import resample as R
from ..sources import fixtures as X
from .sqltext import clamp

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

RGBA = "r, g, b, a"


def _own_sizes(df: DataFrame) -> DataFrame:
    """A new size for each image: 1 to 13 wide, 1 to 11 high, so that axes grow, shrink and stay."""
    return G.sizes_of(df).select("image_id", (F.pmod("image_id", F.lit(13)) + 1).alias("new_width"), (F.pmod(F.col("image_id") * 3, F.lit(11)) + 1).alias("new_height"))


#: (image_id, width, height, nw, nh) of each image with a new size.
_SIZES = "SELECT DISTINCT image_id, width, height, {nw} AS nw, {nh} AS nh FROM mx"
OWN = _SIZES.format(nw="CAST(image_id % 13 + 1 AS INT)", nh="CAST(image_id * 3 % 11 + 1 AS INT)")


def _fitted(cw: int, ch: int, how: str) -> str:
    ratio = f"{'least' if how == 'fit' else 'greatest'}({cw} / (width + 0e0), {ch} / (height + 0e0))"
    return _SIZES.format(nw=f"CAST(trunc(width * {ratio} + 0.5e0) AS INT)", nh=f"CAST(trunc(height * {ratio} + 0.5e0) AS INT)")


def _nearest_sql(sizes: str) -> str:
    return f"""WITH {X.MIXED_SQL}, sz AS ({sizes}),
d AS (SELECT *, unnest(range(0, nw)) AS i FROM sz), dd AS (SELECT *, unnest(range(0, nh)) AS j FROM d)
SELECT dd.image_id, nw AS width, nh AS height, CAST(i AS INT) AS x, CAST(j AS INT) AS y, {RGBA} FROM dd JOIN mx
  ON mx.image_id = dd.image_id AND mx.x = (i * (dd.width * 65536 // nw)) >> 16 AND mx.y = (j * (dd.height * 65536 // nh)) >> 16"""


QUERIES["c1_resize_mixed"] = lambda spark, d: (lambda df: G.resize_each(df, _own_sizes(df)))(X.mixed(spark, d))
ORACLE_SQL["c1_resize_mixed"] = _nearest_sql(OWN)
QUERIES["c2_fill_mixed"] = lambda spark, d: (lambda df: G.resize_each(df, G.fitted_sizes(G.sizes_of(df), (7, 5), "fill")))(X.mixed(spark, d))
ORACLE_SQL["c2_fill_mixed"] = _nearest_sql(_fitted(7, 5, "fill"))
QUERIES["c5_calculated_sizes"] = lambda spark, d: (lambda images: G.calculated_sizes(images, width=10).withColumn("by", F.lit("width")).unionByName(G.calculated_sizes(images, height=9).withColumn("by", F.lit("height"))))(G.sizes_of(X.mixed(spark, d)))
ORACLE_SQL["c5_calculated_sizes"] = f"""WITH {X.MIXED_SQL}, sz AS (SELECT DISTINCT image_id, width, height FROM mx)
SELECT image_id, 10 AS new_width, CAST(trunc(height * 10 / (width + 0e0) + 0.5e0) AS INT) AS new_height, 'width' AS by FROM sz
UNION ALL SELECT image_id, CAST(trunc(width * 9 / (height + 0e0) + 0.5e0) AS INT), 9, 'height' FROM sz"""

#: Filters as DuckDB expressions of the distance x, with their supports.
_X = "abs(x)"
_SINC = "CASE WHEN {0} = 0 THEN 1e0 ELSE sin(pi() * {0}) / (pi() * {0}) END"
FILTERS = {
    "box": ("CASE WHEN -0.5e0 <= x AND x < 0.5e0 THEN 1e0 ELSE 0e0 END", 0.5),
    "triangle": (f"greatest(0e0, 1 - {_X})", 1.0),
    "hermite": (f"CASE WHEN {_X} < 1 THEN (2 * {_X} - 3) * x * x + 1 ELSE 0e0 END", 1.0),
    "bell": (f"CASE WHEN {_X} < 0.5e0 THEN 0.75e0 - x * x WHEN {_X} < 1.5e0 THEN 0.5e0 * (({_X} - 1.5e0) * ({_X} - 1.5e0)) ELSE 0e0 END", 1.5),
    "bspline": (f"CASE WHEN {_X} < 1 THEN 0.5e0 * {_X} * {_X} * {_X} - {_X} * {_X} + 2 / 3e0 WHEN {_X} < 2 THEN (2 - {_X}) * (2 - {_X}) * (2 - {_X}) / 6 ELSE 0e0 END", 2.0),
    "lanczos3": (f"CASE WHEN {_X} < 3 THEN ({_SINC.format('x')}) * ({_SINC.format('(x / 3)')}) ELSE 0e0 END", 3.0),
}


def _axis_sql(source: str, axis: str, name: str, mode: str, low: str, high: str) -> str:
    """One pass: the taps of each distinct (size, new), beyond the edges reflected or taken around, then the sums."""
    f, support = FILTERS[mode]
    size, new, other = ("width", "nw", "y") if axis == "x" else ("height", "nh", "x")
    sc = "(size / (new + 0e0))"
    below, above = ("j0 + size" if low == "wrap" else "-j0"), ("j0 - size" if high == "wrap" else "2 * size - j0 - 1")
    shrunk = f"SELECT size, new, i, least(CAST(trunc(i * {sc} + 0.5e0) AS INT), size - 1) AS j, 65536 AS w FROM p_{name} WHERE new <= size" if mode == "box" else f"""
  SELECT size, new, i, j, CAST(trunc((least((i + 1) * {sc}, j + 1) - greatest(i * {sc}, j)) / {sc} * 65536) AS BIGINT) AS w
  FROM (SELECT *, unnest(range(CAST(trunc(i * {sc}) AS INT), least(CAST(ceil((i + 1) * {sc}) AS INT), size))) AS j FROM p_{name} WHERE new <= size) WHERE least((i + 1) * {sc}, j + 1) > greatest(i * {sc}, j)"""
    cols = ", ".join(f"{clamp(f'(CAST(sum({c} * w) AS BIGINT) + 32768) >> 16')} AS {c}" for c in "rgba")
    return f"""p_{name} AS (SELECT *, unnest(range(0, new)) AS i FROM (SELECT DISTINCT {size} AS size, {new} AS new FROM sz)),
taps_{name} AS MATERIALIZED (
  SELECT size, new, i, least(greatest(CASE WHEN j0 < 0 THEN {below} WHEN j0 >= size THEN {above} ELSE j0 END, 0), size - 1) AS j, CAST(trunc(({f}) * 65536) AS BIGINT) AS w
  FROM (SELECT *, j0 - i * {sc} AS x FROM (SELECT *, unnest(range(CAST(trunc(i * {sc} - {support}e0) AS INT), CAST(ceil(i * {sc} + {support}e0) AS INT) + 1)) AS j0 FROM p_{name} WHERE new > size))
  UNION ALL {shrunk}),
{name} AS MATERIALIZED (SELECT s.image_id, CAST(t.i AS INT) AS {axis}, s.{other}, {cols} FROM {source} AS s JOIN sz ON sz.image_id = s.image_id JOIN taps_{name} AS t ON t.size = sz.{size} AND t.new = sz.{new} AND t.j = s.{axis}
  GROUP BY s.image_id, t.i, s.{other})"""


def _resample_sql(sizes: str, mode: str, edges: tuple[str, str, str, str] = ("back",) * 4) -> str:
    left, top, right, bottom = edges
    return f"""WITH {X.MIXED_SQL}, sz AS ({sizes}), {_axis_sql('mx', 'x', 'hz', mode, left, right)}, {_axis_sql('hz', 'y', 'vt', mode, top, bottom)}
SELECT image_id, nw AS width, nh AS height, x, y, {RGBA} FROM vt JOIN sz USING (image_id)"""


WRAPPED = ("wrap", "back", "back", "wrap")
for _number, _mode in (("r6", "box"), ("r7", "triangle"), ("r8", "hermite"), ("r9", "bell"), ("r10", "bspline"), ("r13", "lanczos3")):
    QUERIES[f"{_number}_mixed_{_mode}"] = lambda spark, d, mode=_mode: (lambda df: R.resample_each(df, _own_sizes(df), mode))(X.mixed(spark, d))
    ORACLE_SQL[f"{_number}_mixed_{_mode}"] = _resample_sql(OWN, _mode)
QUERIES["r15_mixed_wrapped"] = lambda spark, d: (lambda df: R.resample_each(df, _own_sizes(df), "bell", WRAPPED))(X.mixed(spark, d))
ORACLE_SQL["r15_mixed_wrapped"] = _resample_sql(OWN, "bell", WRAPPED)
QUERIES["c4_mixed_to_fit"] = lambda spark, d: R.resample_each_to_fit(X.mixed(spark, d), (6, 6), "fit", "triangle")
ORACLE_SQL["c4_mixed_to_fit"] = _resample_sql(_fitted(6, 6, "fit"), "triangle")

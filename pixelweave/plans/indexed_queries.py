"""Queries of single-channel images and of palettes as relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import indexed as I
from ..operators import point as P
from ..sources import fixtures as X
from .sqltext import byte

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
OUT = ("image_id", "x", "y", "v")


def on_gray(name: str, op: Callable[[DataFrame], DataFrame], value: str) -> None:
    QUERIES[name] = lambda spark, d: op(X.gray(spark, d)).select(*OUT)
    ORACLE_SQL[name] = f"WITH {X.GRAY_SQL} SELECT image_id, x, y, CAST({value} AS INT) AS v FROM gy"


on_gray("i9_indexed_invert", I.invert, "255 - v")
on_gray("i3_indexed_negate", I.negate, "(256 - v) % 256")
on_gray("i5_indexed_times", lambda d: I.times(d, 3), "v * 3 % 256")
on_gray("i13_indexed_shift", lambda d: I.shifted(d, 2), "(v << 2) & 255")
on_gray("h17_indexed_remap", lambda d: I.remap(d, [(i * 7) % 256 for i in range(256)]), "v * 7 % 256")


def _next(d: DataFrame) -> DataFrame:
    return d.withColumn("image_id", F.col("image_id") - 1)


#: An image's values beside those of the next one, without a join; sx, sy: the place in the next one.
_PAIRS = f"""WITH two AS (SELECT vec_id AS image_id, embedding AS e, CASE WHEN lead(vec_id) OVER (ORDER BY vec_id) = vec_id + 1 THEN lead(embedding) OVER (ORDER BY vec_id) END AS f FROM embeddings),
cells AS (SELECT image_id, CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y, {X.BYTE.format('e[k+1]')} AS dv, f, CAST(k % 8 - {{dx}} AS INT) AS sx, CAST(k // 8 - {{dy}} AS INT) AS sy FROM two, (SELECT unnest(range(0, 64)) AS k)),
met AS (SELECT image_id, x, y, dv, CASE WHEN f IS NOT NULL AND sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN {X.BYTE.format('f[sy*8+sx+1]')} END AS sv FROM cells)"""
_SQL = {"add": "(dv + sv) & 255", "sub": "(dv - sv) & 255", "mul": "(dv * sv) & 255", "rsub": "greatest(sv - dv, 0)", "or": "dv | sv", "and": "dv & sv", "xor": "xor(dv, sv)", "mask": "dv & (255 - sv)", "transparent": "CASE WHEN sv <> 0 THEN sv ELSE dv END"}
for _op, _value in _SQL.items():
    QUERIES[f"i1_indexed_{_op}"] = lambda spark, d, op=_op: I.combine(X.gray(spark, d), _next(X.gray(spark, d)), op).select(*OUT)
    ORACLE_SQL[f"i1_indexed_{_op}"] = f"{_PAIRS.format(dx=0, dy=0)} SELECT image_id, x, y, CAST({_value} AS INT) AS v FROM met WHERE sv IS NOT NULL"
QUERIES["e11_indexed_blit"] = lambda spark, d: I.blit(X.gray(spark, d), _next(X.gray(spark, d)), "add", (3, -2)).select(*OUT)
ORACLE_SQL["e11_indexed_blit"] = f"{_PAIRS.format(dx=3, dy=-2)} SELECT image_id, x, y, CAST(CASE WHEN sv IS NULL THEN dv ELSE (dv + sv) & 255 END AS INT) AS v FROM met"
QUERIES["n1_indexed_content"] = lambda spark, d: I.content_size(X.gray(spark, d), 1, 1, 5, 6, 135)
ORACLE_SQL["n1_indexed_content"] = f"WITH {X.GRAY_SQL} SELECT image_id, coalesce(max(CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 6 AND v > 135 THEN x END), 0) AS content_width, coalesce(max(CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 6 AND v > 135 THEN y END), 0) AS content_height FROM gy GROUP BY image_id"


def _palette(spark, d) -> DataFrame:
    """A palette of each image: its first 16 pixels' colours."""
    px = X.rgba(spark, d)
    return px.select("image_id", (F.col("y") * 8 + F.col("x")).alias("idx"), "r", "g", "b", "a")


_PALETTE = f"{X.RGBA_SQL}, pal AS (SELECT image_id, y * 8 + x AS idx, r, g, b, a FROM px)"


def on_palette(name: str, op: Callable[[DataFrame], DataFrame], **channels: str) -> None:
    QUERIES[name] = lambda spark, d: op(_palette(spark, d))
    ORACLE_SQL[name] = f"WITH {_PALETTE} SELECT image_id, idx, {', '.join(f'CAST({channels.get(c, c)} AS INT) AS {c}' for c in 'rgba')} FROM pal"


on_palette("g3_multiply_palette", lambda p: P.multiply(p, 0.5, 1.25, 1.0), r=byte("r * 0.5e0"), g=byte("g * 1.25e0"))
on_palette("h11_invert_palette", P.invert, r="255 - r", g="255 - g", b="255 - b")
on_palette("g8_remap_palette", lambda p: P.remap_color(p, (128, 128, 128, 255), (1, 2, 3, 4)), **{c: f"CASE WHEN r = 128 AND g = 128 AND b = 128 AND a = 255 THEN {v} ELSE {c} END" for c, v in zip("rgba", (1, 2, 3, 4), strict=True)})


_MATRIX = ((0.5, 0.25, 0.25), (0.0, 1.0, 0.0), (1.0, -0.5, 0.25))
on_palette("g10_remap_palette_matrix", lambda p: P.remap_matrix(p, _MATRIX), **{c: byte(f"({' + '.join(f'{w!r}e0 * (CAST({k} AS DOUBLE) / 255e0)' for w, k in zip(_MATRIX[i], 'rgb', strict=True))}) * 255e0") for i, c in enumerate("rgb")})


def _dictionary(spark, d) -> DataFrame:
    """Colours of image 3's palette become those of image 4's, by index."""
    p = _palette(spark, d)
    source, target = p.where("image_id = 3").drop("image_id"), p.where("image_id = 4").select("idx", *[F.col(c).alias(f"to_{c}") for c in "rgba"])
    return source.join(target, "idx").groupBy(*"rgba").agg(F.min_by(F.struct(*[f"to_{c}" for c in "rgba"]), "idx").alias("t")).select(*"rgba", "t.*")


QUERIES["g9_remap_palette_dictionary"] = lambda spark, d: P.remap_colors(_palette(spark, d), _dictionary(spark, d)).select("image_id", "idx", *"rgba")
ORACLE_SQL["g9_remap_palette_dictionary"] = f"""WITH {_PALETTE}, m AS (SELECT s.r, s.g, s.b, s.a, arg_min(struct_pack(r := t.r, g := t.g, b := t.b, a := t.a), s.idx) AS t FROM pal s JOIN pal t ON s.image_id = 3 AND t.image_id = 4 AND s.idx = t.idx GROUP BY ALL)
SELECT image_id, idx, {', '.join(f'coalesce(m.t.{c}, pal.{c}) AS {c}' for c in 'rgba')} FROM pal LEFT JOIN m USING (r, g, b, a)"""


def _gray256(spark, d) -> DataFrame:
    index = X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int"))
    palette = _palette(spark, d).where("image_id = 3").select("idx", "r", "g", "b")
    return I.to_grayscale256(index, palette).select(*OUT)


QUERIES["h6_to_grayscale256"] = _gray256
ORACLE_SQL["h6_to_grayscale256"] = f"WITH {_PALETTE}, {X.GRAY_SQL} SELECT gy.image_id, gy.x, gy.y, CAST((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS INT) AS v FROM gy JOIN pal ON pal.image_id = 3 AND idx = v // 16"
QUERIES["n7_is_grayscale256"] = lambda spark, d: I.is_grayscale256(_palette(spark, d))
ORACLE_SQL["n7_is_grayscale256"] = f"WITH {_PALETTE} SELECT image_id, bool_and(r = idx AND g = idx AND b = idx AND a = 255) AND count(*) = 256 AS identity FROM pal GROUP BY image_id"

"""Rectangles as four INT columns (x, y, w, h), half open."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rect = dict[str, Column]
#: Keys of equal rectangles that go into one list, about, and candidate pairs that one task and one key of a join should meet.
LISTED, TASK_PAIRS, KEY_PAIRS = 1024, 1 << 22, 1 << 23
#: Tasks and salts of a join at most, however many pairs there are: the copies of the right side do not grow further.
TASKS, SALTS = 4096, 16


def rect(prefix: str = "") -> Rect:
    return {k: F.col(prefix + k) for k in ("x", "y", "w", "h")}


def of(x, y, w, h) -> Rect:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return {"x": as_column(x), "y": as_column(y), "w": as_column(w), "h": as_column(h)}


def right(r: Rect) -> Column:
    return r["x"] + r["w"]


def bottom(r: Rect) -> Column:
    return r["y"] + r["h"]


def center(r: Rect) -> tuple[Column, Column]:
    return F.expr("0") + r["x"] + F.floor(r["w"] / 2).cast("int"), r["y"] + F.floor(r["h"] / 2).cast("int")


def from_edges(left: Column, top: Column, right_: Column, bottom_: Column) -> Rect:
    return {"x": left, "y": top, "w": right_ - left, "h": bottom_ - top}


def contains_point(r: Rect, px: Column, py: Column) -> Column:
    return (px >= r["x"]) & (py >= r["y"]) & (px < right(r)) & (py < bottom(r))


def contains(r: Rect, s: Rect) -> Column:
    return (s["x"] >= r["x"]) & (s["y"] >= r["y"]) & (right(s) <= right(r)) & (bottom(s) <= bottom(r))


def intersects(r: Rect, s: Rect) -> Column:
    """Open overlap: rectangles that only touch do not intersect."""
    return (r["x"] < right(s)) & (s["x"] < right(r)) & (r["y"] < bottom(s)) & (s["y"] < bottom(r))


def intersect(r: Rect, s: Rect) -> Rect:
    """The overlap, or (0, 0, 0, 0)."""
    x, y = F.greatest(r["x"], s["x"]), F.greatest(r["y"], s["y"])
    w, h = F.least(right(r), right(s)) - x, F.least(bottom(r), bottom(s)) - y
    hit = (w > 0) & (h > 0)
    return {k: F.when(hit, v).otherwise(0) for k, v in {"x": x, "y": y, "w": w, "h": h}.items()}


def union(r: Rect, s: Rect) -> Rect:
    """The bounding box."""
    x, y = F.least(r["x"], s["x"]), F.least(r["y"], s["y"])
    return from_edges(x, y, F.greatest(right(r), right(s)), F.greatest(bottom(r), bottom(s)))


def clip(r: Rect, width: Column | int, height: Column | int) -> Rect:
    """Clipped to (0, 0, width, height); the size may turn negative outside."""
    width, height = F.lit(width), F.lit(height)
    x, y = F.greatest(r["x"], F.lit(0)), F.greatest(r["y"], F.lit(0))
    return {"x": x, "y": y, "w": F.least(right(r), width) - x, "h": F.least(bottom(r), height) - y}


def grow(r: Rect, across: int, down: int) -> Rect:
    return {"x": r["x"] - across, "y": r["y"] - down, "w": r["w"] + 2 * across, "h": r["h"] + 2 * down}


def add(r: Rect, s: Rect, sign: int = 1) -> Rect:
    return {k: r[k] + sign * s[k] for k in r}


def equal(r: Rect, s: Rect) -> Column:
    return (r["x"] == s["x"]) & (r["y"] == s["y"]) & (r["w"] == s["w"]) & (r["h"] == s["h"])


def hash32(r: Rect) -> Column:
    """((x * 65599 + y) * 65599 + w) * 65599 + h in wrapping 32-bit arithmetic, as an int."""
    h = F.lit(0).cast("long")
    for k in ("x", "y", "w", "h"):
        h = F.pmod(h * 65_599 + r[k], F.lit(1 << 32))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def resized(r: Rect, k: int) -> Rect:
    """Only the size is multiplied."""
    return r | {"w": r["w"] * k, "h": r["h"] * k}


def shrunk(r: Rect, k: int) -> Rect:
    """Only the size is divided, toward zero."""
    cut = lambda v: (v / k).cast("int")
    return r | {"w": cut(r["w"]), "h": cut(r["h"])}


def offset(r: Rect, dx: int, dy: int) -> Rect:
    return r | {"x": r["x"] + dx, "y": r["y"] + dy}


def transposed(r: Rect) -> Rect:
    return {"x": r["y"], "y": r["x"], "w": r["h"], "h": r["w"]}


def flipped_horz(r: Rect, axis: int = 0) -> Rect:
    """Mirrored about the vertical line x = axis."""
    return r | {"x": 2 * axis - right(r)}


def flipped_vert(r: Rect, axis: int = 0) -> Rect:
    return r | {"y": 2 * axis - bottom(r)}


def scaled(r: Rect, k: float) -> Rect:
    return {n: (v * k + 0.5).cast("int") for n, v in r.items()}


def text(r: Rect) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", r["x"].cast("string"), r["y"].cast("string")), F.lit(") ["), r["w"].cast("string"), F.lit("x"), r["h"].cast("string"), F.lit("]"))


def listed(df: DataFrame, key: str) -> DataFrame:
    """(x, y, w, h, keys) of rows (key, x, y, w, h): equal rectangles share a row; the keys of many are dealt to lists of about LISTED. Null keys are left out."""
    df = df.where(F.col(key).isNotNull())
    most = df.groupBy("x", "y", "w", "h").count().agg(F.max("count")).first()[0] or 1
    dealt = df.withColumn("__list", F.pmod(F.xxhash64(key), F.lit(math.ceil(most / LISTED))))
    return dealt.groupBy("x", "y", "w", "h", "__list").agg(F.collect_list(key).alias("keys")).drop("__list")


def intersecting(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Rows of `listed` rectangles `a` and `b` that intersect, those of b with the prefix s_: a range join, bucketed on a grid of cells of `size`
    so that it is an equi-join; each pair is kept only in the cell of its overlap's corner. Where many keys meet in a cell, lists of a are
    salted and those of b copied to each salt; tasks are as many as the pairs of keys ask for, which are far more than the rows that meet."""
    cell = lambda v: F.floor(v / size).cast("int")

    def celled(df):
        return df.withColumn("cx", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x") + F.col("w") - 1)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y")), cell(F.col("y") + F.col("h") - 1))))

    load = lambda df, n: celled(df.withColumn("keys", F.size("keys"))).groupBy("cx", "cy").agg(F.sum("keys").cast("double").alias(n))
    met = load(a, "n").join(load(b, "m"), ["cx", "cy"]).agg(F.max(F.col("n") * F.col("m")).alias("most"), F.sum(F.col("n") * F.col("m")).alias("all")).first()
    salts, tasks = (max(1, min(top, math.ceil((v or 0) / of))) for v, of, top in ((met["most"], KEY_PAIRS, SALTS), (met["all"], TASK_PAIRS, TASKS)))
    r, s = rect(), rect("s_")
    i, at = intersect(r, s), ["cx", "cy", "salt"]
    left = celled(a).withColumn("salt", F.pmod(F.xxhash64("x", "y", "w", "h", "keys"), F.lit(salts)).cast("int"))
    right = celled(b).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(*at, *[F.col(c).alias(f"s_{c}") for c in (*"xywh", "keys")])
    # Many rows of a cell meet each of the other side: hashing spares their sort and replay.
    joined = left.repartition(tasks, *at).join(right.repartition(tasks, *at).hint("shuffle_hash"), at)
    return joined.where(intersects(r, s) & (F.col("cx") == cell(i["x"])) & (F.col("cy") == cell(i["y"]))).drop(*at)


def paired(met: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each pair of keys of `intersecting`'s lists, as a and b, beside the other columns; all keys of b's list in turn. Spark compiles a join and the explodes
    above it into one loop, which keeps all that one row of the join's left side gives until that row is done: the product of a list with every list
    that it meets. Coalescing to TASKS, which leaves partitions as they are, parts the loops, so a task holds the rows of one list at a time."""
    rest = [c for c in met.columns if c not in ("keys", "s_keys")]
    each = met.coalesce(TASKS).select(F.explode("keys").alias(a), "s_keys", *rest)
    return each.coalesce(TASKS).select(a, F.explode("s_keys").alias(b), *rest)

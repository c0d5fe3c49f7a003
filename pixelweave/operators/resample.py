"""Filtered resampling in two separable passes over contribution tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, clamp8
from .geometry import fit, fitted_sizes, sizes_of, with_sizes


def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def _bspline(x: float) -> float:
    x = abs(x)
    return (0.5 * x * x * x - x * x + 2 / 3) if x < 1 else ((2 - x) ** 3 / 6 if x < 2 else 0.0)


def _mitchell(x: float, b: float = 1 / 3, c: float = 1 / 3) -> float:
    x = abs(x)
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x * x + 6 - 2 * b) / 6
    if x < 2:
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x * x + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
    return 0.0


def _bell(x: float) -> float:
    x = abs(x)
    return 0.75 - x * x if x < 0.5 else (0.5 * (x - 1.5) ** 2 if x < 1.5 else 0.0)


def _lanczos(n: int) -> tuple[Callable[[float], float], float]:
    return (lambda x: _sinc(x) * _sinc(x / n) if abs(x) < n else 0.0), float(n)


#: Filter and support by name.
FILTERS: dict[str, tuple[Callable[[float], float], float]] = {
    "box": (lambda x: 1.0 if -0.5 <= x < 0.5 else 0.0, 0.5),
    "triangle": (lambda x: max(0.0, 1 - abs(x)), 1.0),
    "hermite": (lambda x: (2 * abs(x) - 3) * x * x + 1 if abs(x) < 1 else 0.0, 1.0),
    "bell": (_bell, 1.5),
    "bspline": (_bspline, 2.0),
    "mitchell": (_mitchell, 2.0),
    **{f"lanczos{n}": _lanczos(n) for n in (3, 5, 7, 9, 11)},
}


def contributions(size: int, new: int, mode: str = "bspline", low: str = "back", high: str = "back") -> list[tuple[int, int, int]]:
    """(destination, source, weight in 16.16) of one axis.

    Enlarging uses the filter around i * scale; shrinking by any filter but box is the area average, and box
    takes the nearest source. Beyond the edges `back` reflects and `wrap` goes around.
    """
    if size <= 0 or new <= 0:
        raise ValueError("sizes must be positive")
    scale, found = size / new, []

    def inside(j: int) -> int:
        if j < 0:
            j = j + size if low == "wrap" else -j
        elif j >= size:
            j = j - size if high == "wrap" else 2 * size - j - 1
        return min(max(j, 0), size - 1)

    f, support = FILTERS[mode]
    for i in range(new):
        if new > size:
            c = i * scale
            found += [(i, inside(j), f(j - c)) for j in range(int(c - support), math.ceil(c + support) + 1)]
        elif mode == "box":
            found.append((i, min(int(i * scale + 0.5), size - 1), 1.0))
        else:
            a, b = i * scale, (i + 1) * scale
            found += [(i, j, (min(b, j + 1) - max(a, j)) / scale) for j in range(int(a), min(math.ceil(b), size)) if min(b, j + 1) > max(a, j)]
    summed: dict[tuple[int, int], int] = {}
    for d, s, w in found:
        summed[d, s] = summed.get((d, s), 0) + int(w * 65_536)
    return [(d, s, w) for (d, s), w in summed.items() if w]


def _pass(df: DataFrame, axis: str, size_column: str, size: int, new: int, mode: str, low: str, high: str) -> DataFrame:
    """Every pixel goes, weighted, to the destinations it adds to; sums are integers, so order is no matter."""
    by_source: dict[int, list[tuple[int, int]]] = {}
    for d, s, w in contributions(size, new, mode, low, high):
        by_source.setdefault(s, []).append((d, w))
    if size <= 4_096:  # a literal table; beyond, a join
        entries = F.array(*[F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in by_source.get(s, [])]) if by_source.get(s) else F.expr("cast(array() as array<struct<d: int, w: int>>)") for s in range(size)])
        spread = df.withColumn("__t", F.explode(F.element_at(entries, F.col(axis) + 1)))
    else:
        rows = df.sparkSession.createDataFrame([(s, d, w) for s, t in by_source.items() for d, w in t], f"{axis} int, d int, w int")
        spread = df.join(rows, axis).withColumn("__t", F.struct("d", "w"))
    other = "y" if axis == "x" else "x"
    other_size = "height" if axis == "x" else "width"
    sums = spread.groupBy("image_id", other_size, F.col("__t.d").alias("d"), other).agg(*[F.sum(F.col(c).cast("long") * F.col("__t.w")).alias(c) for c in CHANNELS])
    return sums.select("image_id", F.lit(new).alias(size_column), other_size, F.col("d").alias(axis), other, *[clamp8(F.shiftright(F.col(c) + 32_768, 16)).alias(c) for c in CHANNELS])


def resample(df: DataFrame, size: tuple[int, int], new: tuple[int, int], mode: str = "bspline", edges: tuple[str, str, str, str] = ("back",) * 4) -> DataFrame:
    """Images of one `size` at a `new` size: along x, rounded to bytes, then along y. `edges` (left, top, right,
    bottom): beyond an edge `back` reflects and `wrap` goes around."""
    if not set(edges) <= {"back", "wrap"}:
        raise ValueError("an edge is back or wrap")
    if size == new:
        return df
    left, top, right, bottom = edges
    out = _pass(_pass(df, "x", "width", size[0], new[0], mode, left, right), "y", "height", size[1], new[1], mode, top, bottom)
    return out.select("image_id", "width", "height", "x", "y", *CHANNELS)


def resample_to_fit(df: DataFrame, size: tuple[int, int], container: tuple[int, int], how: str = "fit", mode: str = "bspline", edges: tuple[str, str, str, str] = ("back",) * 4) -> DataFrame:
    """Images of one `size` at the size that `fit` gives them in a container."""
    return resample(df, size, fit(size, container, how), mode, edges)


def weights(pairs: DataFrame, mode: str = "bspline", low: str = "back", high: str = "back") -> DataFrame:
    """(size, new, source, targets array<struct<d, w>>) for each distinct (size, new) of `pairs`: where a source place
    adds to, and with which weight. One pair is worked out in one task; its rows are as many as its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_source: dict[int, list[dict[str, int]]] = {}
                for d, s, w in contributions(size, new, mode, low, high):
                    by_source.setdefault(s, []).append({"d": d, "w": w})
                rows = list(by_source.items())
                for i in range(0, len(rows), 4_096):
                    part = rows[i : i + 4_096]
                    yield pa.RecordBatch.from_pydict({"size": [size] * len(part), "new": [new] * len(part), "source": [s for s, _ in part], "targets": [t for _, t in part]}, schema=_TARGETS)

    return pairs.where("size > 0 AND new > 0").select("size", "new").distinct().mapInArrow(run, "size int, new int, source int, targets array<struct<d: int, w: int>>")


_TARGETS = pa.schema([("size", pa.int32()), ("new", pa.int32()), ("source", pa.int32()), ("targets", pa.list_(pa.struct([("d", pa.int32()), ("w", pa.int32())])))])


def _pass_each(df: DataFrame, axis: str, mode: str, low: str, high: str) -> DataFrame:
    """One axis of images of any sizes: weights are a relation of the distinct (old, new) sizes, met by an equi-join."""
    size, other, other_size = ("width", "y", "height") if axis == "x" else ("height", "x", "width")
    table = weights(df.select(F.col(size).alias("size"), F.col(f"new_{size}").alias("new")), mode, low, high)
    joined = df.join(table, (F.col(size) == F.col("size")) & (F.col(f"new_{size}") == F.col("new")) & (F.col(axis) == F.col("source")))
    spread = joined.withColumn("__t", F.explode("targets"))
    sums = spread.groupBy("image_id", f"new_{size}", other_size, f"new_{other_size}", F.col("__t.d").alias("d"), other).agg(*[F.sum(F.col(c).cast("long") * F.col("__t.w")).alias(c) for c in CHANNELS])
    return sums.select("image_id", F.col(f"new_{size}").alias(size), f"new_{size}", other_size, f"new_{other_size}", F.col("d").alias(axis), other, *[clamp8(F.shiftright(F.col(c) + 32_768, 16)).alias(c) for c in CHANNELS])


def resample_each(df: DataFrame, sizes: DataFrame, mode: str = "bspline", edges: tuple[str, str, str, str] = ("back",) * 4) -> DataFrame:
    """`resample` of images of any sizes, each to its own size in `sizes` (image_id, new_width, new_height).

    Images that keep a size come through that axis unchanged; those without a row in `sizes`, or with a size
    below 1, are left out. Any number of sizes is one job.
    """
    if not set(edges) <= {"back", "wrap"}:
        raise ValueError("an edge is back or wrap")
    left, top, right, bottom = edges
    sized = with_sizes(df, sizes)
    out = _pass_each(_pass_each(sized, "x", mode, left, right), "y", mode, top, bottom)
    return out.select("image_id", "width", "height", "x", "y", *CHANNELS)


def resample_each_to_fit(df: DataFrame, container: tuple[int, int], how: str = "fit", mode: str = "bspline", edges: tuple[str, str, str, str] = ("back",) * 4) -> DataFrame:
    """Images of any sizes, each at the size that `fit` gives it in a container."""
    return resample_each(df, fitted_sizes(sizes_of(df), container, how), mode, edges)

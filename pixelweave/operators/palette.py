"""Palettes: expansion, nearest colours, median-cut quantization and dithering.

Nearest-colour work is an expression of the pixel, so pixels are not shuffled; a palette has at most 256
entries and is a literal of the plan. Median cut works on an image's histogram, by joins and group-bys where it is large, and error
diffusion on one image at a time, since each pixel needs the errors of those before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, RGB, columns
from ..functions.lineage import cut

Palette = Sequence[Sequence[int]]
KEYS = ("image_id", "width", "height", "x", "y")


def _literal(palette: Palette) -> Column:
    if not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    full = [(*c, 255)[:4] for c in palette]
    return F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(int(v)).alias(k) for k, v in zip(CHANNELS, c, strict=True)]) for i, c in enumerate(full)])


def expand(df: DataFrame, palette: Palette) -> DataFrame:
    """An index image (…, v) in the palette's colours."""
    c = F.element_at(_literal(palette), F.col("v") + 1)
    return df.select(*KEYS, *[c[k].alias(k) for k in CHANNELS])


def nearest(palette: Palette, r: Column, g: Column, b: Column, exclude: Sequence[int] = (), weights: Sequence[float] = (1.0, 1.0, 1.0)) -> Column:
    """Index of the palette entry of least (weighted) rgb distance; the lowest index wins ties."""
    integer = all(w == 1 for w in weights)

    def distance(p: Column) -> Column:
        d = [(p[k] - v) * (F.lit(1) if integer else F.lit(float(w))) for k, v, w in zip(RGB, (r, g, b), weights, strict=True)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    entries = F.filter(_literal(palette), lambda p: ~p["i"].isin(list(exclude))) if exclude else _literal(palette)
    return F.array_min(F.transform(entries, lambda p: F.struct(distance(p).alias("d"), p["i"].alias("i"))))["i"]


def to_palette(df: DataFrame, palette: Palette, exclude: Sequence[int] = ()) -> DataFrame:
    """Index image `v` by nearest colour; the indices in `exclude` are never given."""
    return df.select(*KEYS, nearest(palette, *[F.col(c) for c in RGB], exclude=exclude).alias("v"))


def to_other_palette(df: DataFrame, palette: Palette, other: Palette) -> DataFrame:
    """Index image `v` in `other`'s nearest colours: a table of at most 256 entries, found once."""
    table = [min(range(len(other)), key=lambda i: (sum((int(x) - int(y)) ** 2 for x, y in zip(other[i][:3], c[:3], strict=True)), i)) for c in palette]
    return df.select(*KEYS, F.element_at(F.array(*[F.lit(i) for i in table]), F.col("v") + 1).alias("v"))


def _bayer(n: int) -> list[int]:
    """Threshold map of n x n, n a power of two, row-major; 2 x 2 is 0 3 / 2 1."""
    m = np.array([[0]])
    while len(m) < n:
        m = np.block([[4 * m, 4 * m + 3], [4 * m + 2, 4 * m + 1]])
    return m.flatten().tolist()


def ordered_dither(df: DataFrame, palette: Palette, n: int, weights: Sequence[float] = (0.299, 0.587, 0.114)) -> DataFrame:
    """Index image `v`: between the nearest colour and its mirror image's nearest, by an n x n threshold map.

    For a colour c: closest entry p; if not equal, the alternate is the entry nearest to 2c - p
    without p, by weighted squares; ratio d(c, p) / (d(c, p) + d(c, alternate)); the alternate shows where ratio * n^2, rounded,
    exceeds the threshold.
    """
    table = _literal(palette)
    c = {k: F.col(k) for k in RGB}
    color = df.select(*KEYS, *RGB).withColumn("p", nearest(palette, *c.values(), weights=weights))
    p = F.element_at(table, F.col("p") + 1)
    for k in RGB:
        color = color.withColumn(f"m_{k}", 2 * c[k] - p[k])

    def distance(e: Column, v: dict[str, Column]) -> Column:
        d = [(e[k] - v[k]) * F.lit(float(w)) for k, w in zip(RGB, weights, strict=True)]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    mirror = {k: F.col(f"m_{k}") for k in RGB}
    others = F.filter(table, lambda e: e["i"] != F.col("p"))
    square = lambda e, k: (e[k] - mirror[k]) * (e[k] - mirror[k])  # noqa: E731  here the weight stands outside the square
    apart = lambda e: square(e, "r") * 299 + square(e, "g") * 587 + square(e, "b") * 114
    alternate = F.array_min(F.transform(others, lambda e: F.struct(apart(e).alias("d"), e["i"].alias("i"))))["i"]
    color = color.withColumn("q", F.coalesce(alternate, F.col("p")))
    q = F.element_at(table, F.col("q") + 1)
    dp, dq = F.sqrt(distance(p, c)), F.sqrt(distance(q, c))
    amount = F.when(dp == 0, 0).otherwise((dp / (dp + dq) * (n * n) + 0.5).cast("int"))
    color = color.select(*KEYS, "p", "q", amount.alias("amount"))
    at = (F.pmod(F.col("y"), F.lit(n)) * n + F.pmod(F.col("x"), F.lit(n)) + 1).cast("int")
    threshold = F.element_at(F.array(*[F.lit(v) for v in _bayer(n)]), at)
    return color.select(*KEYS, F.when(F.col("amount") > threshold, F.col("q")).otherwise(F.col("p")).alias("v"))


#: Error diffusion: divisor and (dx, dy, weight) taps, dy >= 0.
# Published weights.
DIFFUSION: dict[str, tuple[int, list[tuple[int, int, int]]]] = {
    "floyd_steinberg": (16, [(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)]),
    "atkinson": (8, [(1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)]),
    "stucki": (42, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)]),
    "burkes": (32, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)]),
    "jarvis": (48, [(1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1)]),
}


def diffuse(images: np.ndarray, palette: np.ndarray, name: str) -> np.ndarray:
    """Indices of (n, h, w, 3) images of one size. Pixels whose inputs are all known form slanted fronts, x + slant * y
    constant, and each front is done at once in all images. A pixel takes its errors in raster order of their
    sources, each followed by a clamp; shifts floor and other divisors truncate."""
    divisor, taps = DIFFUSION[name]
    n, h, w = images.shape[:3]
    slant = max(-dx for dx, dy, _ in taps if dy) + 1
    errors, out = np.zeros((n, h, w, 3), np.int64), np.zeros((n, h, w), dtype=np.int32)
    sources = sorted(taps, key=lambda t: (-t[1], -t[0]))
    for front in range(w + slant * (h - 1)):
        y = np.arange(max(0, -(-(front - w + 1) // slant)), min(h - 1, front // slant) + 1)
        x = front - slant * y
        value = images[:, y, x].astype(np.int64)
        for dx, dy, weight in sources:
            sx, sy = x - dx, y - dy
            ok = (sx >= 0) & (sx < w) & (sy >= 0)
            e = errors[:, sy[ok], sx[ok]] * weight
            share = e // divisor if divisor & (divisor - 1) == 0 else np.trunc(e / divisor).astype(np.int64)
            value[:, ok] = np.clip(value[:, ok] + share, 0, 255)
        v = ((value[:, :, None, :] - palette) ** 2).sum(axis=3).argmin(axis=2)
        out[:, y, x] = v
        errors[:, y, x] = value - palette[v]
    return out


def diffusion_dither(df: DataFrame, palette: Palette, name: str, batch_pixels: int = 1 << 18) -> DataFrame:
    """Index image `v` by error diffusion in raster order; errors are kept as clamped bytes.

    An image is one row of lines, as every pixel depends on those before it; images run in parallel, and those of
    one size in a batch, of `batch_pixels` at most if they are more than one, in the same numpy steps.
    """
    if name not in DIFFUSION:
        raise ValueError(f"unknown diffusion {name}")
    table = np.array([tuple(c)[:3] for c in palette], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column(i).to_numpy() for i in (1, 2)], axis=1)
            for w, h in np.unique(sizes, axis=0).tolist():
                rows = np.flatnonzero((sizes == (w, h)).all(axis=1))
                for k in range(0, len(rows), max(1, batch_pixels // (w * h))):
                    some = rows[k : k + max(1, batch_pixels // (w * h))]
                    held = batch.column(3).take(pa.array(some))
                    cells = pa.StructArray.from_arrays([held.flatten().field(i) for i in range(5)], names=list("xyrgb"))
                    image, x, y, r, g, b = np.repeat(np.arange(len(some)), pa.compute.list_value_length(held).to_numpy()), *[cells.field(i).to_numpy() for i in range(5)]
                    whole = np.zeros((len(some), h, w, 3), dtype=np.int64)
                    whole[image, y, x] = np.stack([r, g, b], axis=1)
                    v = diffuse(whole, table, name)[image, y, x]
                    ids = batch.column(0).take(pa.array(some[image]))
                    n = len(v)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, h, np.int32)), pa.array(x), pa.array(y), pa.array(v)], names=[*KEYS, "v"])

    pixels = F.collect_list(F.struct("x", "y", *RGB)).alias("pixels")
    kind = df.schema["image_id"].dataType.simpleString()
    return df.groupBy("image_id", "width", "height").agg(pixels).mapInArrow(run, f"image_id {kind}, width int, height int, x int, y int, v int")


def median_cut(colors: np.ndarray, counts: np.ndarray, n: int, use_original: bool = False) -> list[tuple[int, ...]]:
    """At most `n` colours for distinct `colors` (k, c) with their counts, as sorted tuples.

    The bucket with the widest channel is split at its population median until there are n. A bucket becomes
    its median colour, or the mean of its distinct colours in gamma 2.2.
    """
    if not 2 <= n <= 256:
        raise ValueError("2 to 256 colours")
    if len(colors) <= n:
        return sorted(map(tuple, colors.tolist()))
    span = lambda c: int((c.max(axis=0) - c.min(axis=0)).max())
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-span(colors), 0, colors, counts)]
    made = 1
    while len(heap) < n and heap[0][0] < 0:
        _, _, c, k = heapq.heappop(heap)
        channel = int((c.max(axis=0) - c.min(axis=0)).argmax())
        order = np.lexsort((*c.T[::-1], c[:, channel]))
        c, k = c[order], k[order]
        at = int(np.searchsorted(np.cumsum(k), k.sum() / 2)) + 1
        at = min(max(at, 1), len(c) - 1)
        for part in (slice(None, at), slice(at, None)):
            heapq.heappush(heap, (-span(c[part]), made, c[part], k[part]))
            made += 1
    out = set()
    for _, _, c, k in heap:
        if use_original:  # in the order of the bucket's own widest channel
            order = np.lexsort((*c.T[::-1], c[:, int((c.max(axis=0) - c.min(axis=0)).argmax())]))
            c, k = c[order], k[order]
            out.add(tuple(c[min(int(np.searchsorted(np.cumsum(k), k.sum() / 2)), len(c) - 1)].tolist()))
        else:
            mean = ((c / 255.0) ** 2.2).mean(axis=0) ** (1 / 2.2) * 255 + 0.5
            out.add(tuple(np.clip(mean.astype(np.int64), 0, 255).tolist()))
    return sorted(out)


#: Distinct colours of an image up to which one task cuts it.
IN_TASK = 1 << 16


def quantize(df: DataFrame, n: int, use_original: bool = False, include_alpha: bool = False, in_task: int = IN_TASK) -> DataFrame:
    """(image_id, idx, r, g, b, a): a median-cut palette of each image, sorted by colour.

    Counting is a distributed group-by. Images of at most `in_task` distinct colours are cut in one task each; those
    of more by `split_buckets`, which never gathers a bucket's colours.
    """
    if not 2 <= n <= 256:
        raise ValueError("2 to 256 colours")
    names, kind = list(CHANNELS if include_alpha else RGB), df.schema["image_id"].dataType.simpleString()
    counted = cut(df.groupBy("image_id", *names).agg(F.count(F.lit(1)).alias("n")))
    many = cut(counted.groupBy("image_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > in_task).select(F.col("image_id").alias("large")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names)
        found = median_cut(pdf[names].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64), n, use_original)
        out = pd.DataFrame(found, columns=names)
        if not include_alpha:
            out["a"] = 255
        return out.assign(image_id=pdf["image_id"].iloc[0], idx=range(len(out)))[["image_id", "idx", *CHANNELS]]

    small = counted if many.isEmpty() else counted.join(many, F.col("image_id").eqNullSafe(F.col("large")), "left_anti")
    done = small.groupBy("image_id").applyInPandas(run, f"image_id {kind}, idx int, r int, g int, b int, a int")
    if many.isEmpty():
        return done
    large = counted.join(many, F.col("image_id").eqNullSafe(F.col("large")), "left_semi")
    return done.unionByName(_bucket_colors(split_buckets(large, names, n), names, use_original))


def _key(names: Sequence[str], channel: Column) -> Column:
    """A colour's place in the order of one channel, ties by all: the channel's byte before those of `names`."""
    key = F.get(F.array(*[F.col(c).cast("long") for c in names]), channel)
    for c in names:
        key = key * 256 + F.col(c)
    return key


def _medians(colors: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """`wanted` (image, at, channel, total) with `median`, the first key at which half of the bucket's pixels are reached, and
    `last`, its largest key.

    The key is found a byte at a time: pixels are summed by the next byte of the keys that begin like the median, at most
    256 sums a bucket, so no bucket is sorted or gathered.
    """
    steps = len(names) + 1
    state = wanted.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "last": F.lit(None).cast("long")})
    for k in range(steps):
        shift = 8 * (steps - 1 - k)
        met = colors.join(state, colors["image_id"].eqNullSafe(state["image"]) & (colors["bucket"] == state["at"])).withColumn("key", _key(names, F.col("channel")))
        here = met.where(F.shiftright("key", shift + 8) == F.col("prefix"))
        sums = here.groupBy("image", "at", "channel", "total", "prefix", "before", "last", F.shiftright("key", shift).alias("next")).agg(F.sum("n").alias("n"), F.max("key").alias("top"))
        along = Window.partitionBy("image", "at").orderBy("next")
        summed = sums.withColumn("until", F.col("before") + F.sum("n").over(along)).withColumn("last", F.coalesce("last", F.max("top").over(Window.partitionBy("image", "at"))))
        reached = summed.where(F.col("until") >= F.col("total") / 2)
        first = reached.withColumn("rank", F.row_number().over(along)).where("rank = 1")
        state = cut(first.select("image", "at", "channel", "total", F.col("next").alias("prefix"), (F.col("until") - F.col("n")).alias("before"), "last"))
    return state.withColumnRenamed("prefix", "median").drop("before")


_SPANS = "image {0}, at string, span int, channel int, total long, size long"


def split_buckets(colors: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """`colors` (image_id, `names`, n) with `bucket` string: the median cut's at most `n` buckets of each image.

    All images are cut at once. In a round each image's queue of buckets, at most a few hundred numbers, is played as far as the splits
    known so far reach; the buckets that it asks for are split at their medians by joins and group-bys. Rounds are as many as
    the queue is deep. The path of a bucket from the whole image is its name; it is null in images of at most `n` colours, which are not cut.
    """
    kind = colors.schema["image_id"].dataType.simpleString()
    colors = cut(colors.withColumn("bucket", F.lit("")))
    nodes, fresh = None, colors
    while True:
        spans = [(F.max(c) - F.min(c)) for c in names]
        grouped = fresh.groupBy(F.col("image_id").alias("image"), F.col("bucket").alias("at"))
        new = grouped.agg(F.array(*spans).alias("spans"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
        new = new.select("image", "at", F.array_max("spans").cast("int").alias("span"), (F.array_position("spans", F.array_max("spans")) - 1).cast("int").alias("channel"), "total", "size")
        nodes = cut(new if nodes is None else nodes.unionByName(new))
        asked = cut(nodes.groupBy("image").applyInPandas(_played(n), f"image {kind}, at string, leaf string, split boolean"))
        wanted = nodes.join(asked.where("split").select(F.col("image").alias("i"), F.col("at").alias("cut_at")), nodes["image"].eqNullSafe(F.col("i")) & (F.col("at") == F.col("cut_at"))).select("image", "at", "channel", "total")
        if wanted.isEmpty():
            named = asked.select(F.col("image").alias("i"), F.col("at").alias("cut_at"), "leaf")
            return colors.join(named, colors["image_id"].eqNullSafe(F.col("i")) & (F.col("bucket") == F.col("cut_at"))).select("image_id", *names, "n", F.col("leaf").alias("bucket"))
        cuts = _medians(colors, cut(wanted), names).select(F.col("image").alias("i"), F.col("at").alias("cut_at"), "channel", "median", "last")
        met = colors.join(cuts, colors["image_id"].eqNullSafe(F.col("i")) & (F.col("bucket") == F.col("cut_at")), "left")
        key = _key(names, F.col("channel"))
        low = (key < F.col("median")) | (key == F.col("median")) & (F.col("median") < F.col("last"))
        colors = cut(met.select("image_id", *names, "n", F.when(F.col("cut_at").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.when(low, "0").otherwise("1"))).alias("bucket"), F.col("cut_at").isNotNull().alias("moved")))
        fresh, colors = colors.where("moved").drop("moved"), colors.drop("moved")


def _played(n: int):
    """The queue of one image's buckets: (image, at, leaf, split) of each known bucket that is not split yet, with the bucket of the result that
    it lies in, or which has to be split to go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {r.at: r for r in pdf.itertuples()}
        ends = [at for at in known if at + "0" not in known]
        asked = set()
        heap: list[tuple[int, int, str]] = [(-known[""].span, 0, "")]
        size, made = 1, 1
        while known[""].size > n and size < n and heap and heap[0][0] < 0:
            at = heapq.heappop(heap)[2]
            size += 1
            if at in ends:
                asked.add(at)
                continue
            for part in (at + "0", at + "1"):
                heapq.heappush(heap, (-known[part].span, made, part))
                made += 1
        leaves = {at for _, _, at in heap} if known[""].size > n else {""}
        inside = [next((at[:k] for k in range(len(at) + 1) if at[:k] in leaves), at) for at in ends]
        if known[""].size <= n:  # every colour is a bucket
            inside = [None] * len(ends)
        return pd.DataFrame({"image": pdf["image"].iloc[0], "at": ends, "leaf": inside, "split": [at in asked for at in ends]})

    return run


def _bucket_colors(colors: DataFrame, names: Sequence[str], use_original: bool) -> DataFrame:
    """(image_id, idx, r, g, b, a) of the colours of `split_buckets`' buckets."""
    alone = F.concat(F.lit("c"), _key(names, F.lit(0)).cast("string"))
    colors = colors.withColumn("bucket", F.coalesce("bucket", alone))
    image, at = F.col("image_id").alias("image"), F.col("bucket").alias("at")
    if use_original:
        spans = F.array(*[F.max(c) - F.min(c) for c in names])
        told = colors.groupBy(image, at).agg(spans.alias("spans"), F.sum("n").alias("total"))
        found = _medians(colors, cut(told.select("image", "at", (F.array_position("spans", F.array_max("spans")) - 1).cast("int").alias("channel"), "total")), names)
        byte = lambda k: F.shiftright("median", 8 * (len(names) - 1 - k)).bitwiseAND(255).cast("int")
        made = found.select("image", *[byte(k).alias(c) for k, c in enumerate(names)])
    else:
        mean = lambda c: F.least(F.greatest(F.floor(F.pow(F.avg(F.pow(F.col(c) / 255.0, F.lit(2.2))), F.lit(1 / 2.2)) * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")
        made = colors.groupBy(image, at).agg(*[mean(c).alias(c) for c in names]).drop("at")
    if "a" not in names:
        made = made.withColumn("a", F.lit(255))
    order = Window.partitionBy("image").orderBy(*CHANNELS)  # at most 256 rows an image
    return made.distinct().select(F.col("image").alias("image_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"), *CHANNELS)


def to_own_palette(df: DataFrame, n: int) -> DataFrame:
    """Index image `v` in each image's own median-cut palette (nearest colour).

    Distinct colours meet their image's palette entries, at most n, by a join on the image.
    """
    palette = quantize(df, n).select("image_id", "idx", *[F.col(c).alias(f"p_{c}") for c in RGB])
    colors = df.select("image_id", *RGB).distinct()
    d = sum(((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in RGB), F.lit(0))
    best = colors.join(palette, "image_id").groupBy("image_id", *RGB).agg(F.min(F.struct(d.alias("d"), "idx"))["idx"].alias("v"))
    return df.join(best, ["image_id", *RGB]).select(*KEYS, "v")


def combine_frames(frames: Iterator[DataFrame]) -> DataFrame:
    """Images of one animation as one relation with a frame number."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("frame_no", F.lit(i))
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no frames")
    return out

"""Layered sprite files (.ase, .aseprite) as relations of frames, layers and cels.

The container format is public. A file becomes rows of its cels, each with its frame, its layer and its
pixels; a linked cel repeats the pixels of the frame it names. Compositing is then a blit by rows. Layers form a
tree of groups: their full paths and what they inherit come from pointers that are doubled by joins, and a cel is put on the
canvas by a join of coordinates.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .files import unpack

MAGIC, FRAME_MAGIC = 0xA5E0, 0xF1FA
LAYER, CEL, PALETTE, TAGS = 0x2004, 0x2005, 0x2019, 0x2018
CEL_SCHEMA = "path string, image_width int, image_height int, frame_no int, duration_ms int, layer_index int, layer_name string, layer_visible boolean, parent_index int, cel_x int, cel_y int, opacity int, width int, height int, data binary"
TAG_SCHEMA = "path string, name string, first_frame int, last_frame int, direction int"
LAYER_SCHEMA = "path string, image_width int, image_height int, layer_index int, name string, is_group boolean, visible boolean, level int, parent_index int"


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<H", data, at)[0]
    return data[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n


def _pixels(raw: bytes, w: int, h: int, depth: int, palette: np.ndarray, clear: int) -> bytes:
    if depth == 32:
        return raw[: w * h * 4]
    if depth == 16:
        ga = np.frombuffer(raw, np.uint8, w * h * 2).reshape(-1, 2)
        return np.stack([ga[:, 0], ga[:, 0], ga[:, 0], ga[:, 1]], axis=1).tobytes()
    index = np.frombuffer(raw, np.uint8, w * h)
    out = palette[index].copy()
    out[index == clear] = 0
    return out.tobytes()


def parse(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(cels, tags, layers) of one file, without the path; anything else is a ValueError."""
    if len(data) < 128 or struct.unpack_from("<H", data, 4)[0] != MAGIC:
        raise ValueError("no sprite file")
    frames, width, height, depth = struct.unpack_from("<4H", data, 6)
    clear = data[28]
    palette = np.zeros((256, 4), np.uint8)
    layers: list[tuple[str, bool, int | None, bool]] = []
    levels: list[int] = []
    cels: list[tuple] = []
    tags: list[tuple] = []
    drawn: dict[tuple[int, int], tuple[int, int, bytes]] = {}
    at = 128
    for frame in range(frames):
        size, magic, old, duration, _, new = struct.unpack_from("<IHHHHI", data, at)
        if magic != FRAME_MAGIC:
            break
        chunk = at + 16
        for _ in range(new or old):
            n, kind = struct.unpack_from("<IH", data, chunk)
            body = data[chunk + 6 : chunk + n]
            if kind == LAYER:
                flags, sort, level = struct.unpack_from("<3H", body)
                above = [i for i, v in enumerate(levels) if v == level - 1]
                layers.append((_text(body, 16)[0], bool(flags & 1), above[-1] if level and above else None, sort == 1))
                levels.append(level)
            elif kind == PALETTE:
                _, first, last = struct.unpack_from("<3I", body)
                p = 20
                for i in range(first, min(last, 255) + 1):
                    named = struct.unpack_from("<H", body, p)[0] & 1
                    palette[i] = np.frombuffer(body, np.uint8, 4, p + 2)
                    p = _text(body, p + 6)[1] if named else p + 6
            elif kind == TAGS:
                p = 10
                for _ in range(struct.unpack_from("<H", body)[0]):
                    a, b, direction = struct.unpack_from("<HHB", body, p)
                    name, p = _text(body, p + 17)
                    tags.append((name, a, b, direction))
            elif kind == CEL:
                layer, x, y, opacity, coding = struct.unpack_from("<HhhBH", body)
                if coding == 1:
                    w, h, pixels = drawn.get((struct.unpack_from("<H", body, 16)[0], layer), (0, 0, b""))
                elif coding in (0, 2):
                    w, h = struct.unpack_from("<2H", body, 16)
                    raw = zlib.decompress(body[20:]) if coding == 2 else body[20:]
                    pixels = _pixels(raw, w, h, depth, palette, clear)
                else:
                    w = h = 0
                    pixels = b""
                drawn[frame, layer] = (w, h, pixels)
                name, visible, parent, _ = layers[layer] if layer < len(layers) else ("", True, None, False)
                cels.append((width, height, frame, duration, layer, name, visible, parent, x, y, opacity, w, h, pixels))
            chunk += n
        at += size
    told = [(width, height, i, name, group, visible, levels[i], parent) for i, (name, visible, parent, group) in enumerate(layers)]
    return cels, tags, told


def _rows(files: DataFrame, which: int, schema: str) -> DataFrame:
    """Rows of one kind with an error column; a file that cannot be read is a row with its path and the error."""
    fields = [*[tuple(f.strip().split(" ")) for f in schema.split(",")], ("error", "string")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a batch a file
                try:
                    rows = [(path, *r, None) for r in parse(content.as_py() or b"")[which]]
                except (struct.error, zlib.error, ValueError, IndexError) as e:
                    rows = [(path, *[None] * (len(fields) - 2), f"broken file: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, schema + ", error string")


def cels(files: DataFrame) -> DataFrame:
    """A row for each cel of (path, content) files; `files.unpack` gives its pixels. Broken files give none; `broken` tells why."""
    return _rows(files, 0, CEL_SCHEMA).where("error IS NULL").drop("error")


def tags(files: DataFrame) -> DataFrame:
    """(path, name, first_frame, last_frame, direction) of the animation tags."""
    return _rows(files, 1, TAG_SCHEMA).where("error IS NULL").drop("error")


def layers(files: DataFrame) -> DataFrame:
    """(path, image_width, image_height, layer_index, name, is_group, visible, level, parent_index): a row for each layer, from
    the bottom, with the index of the group that it is in."""
    return _rows(files, 2, LAYER_SCHEMA).where("error IS NULL").drop("error")


def broken(files: DataFrame) -> DataFrame:
    """(path, error) of the files that cannot be read."""
    return _rows(files, 1, TAG_SCHEMA).where("error IS NOT NULL").select("path", "error")


def layer_paths(tree: DataFrame) -> DataFrame:
    """`tree` (path, layer_index, name, visible, parent_index, ...) with full_path (names from the outermost group, joined by
    slashes), depth and shown (it and all its groups are visible).

    Pointer doubling: a layer knows the names up to its 2^k-th group after k joins. A parent that does not exist makes a
    layer an outermost one; layers on a cycle of parents have null there.
    """
    tree = cut(tree.where("layer_index IS NOT NULL"))
    known = tree.select(F.col("path").alias("p"), F.col("layer_index").alias("i"))
    state = tree.join(known, F.col("path").eqNullSafe(F.col("p")) & (F.col("parent_index") == F.col("i")), "left").select(
        "path", "layer_index", F.col("i").alias("up"), F.coalesce("name", F.lit("")).alias("full_path"), F.lit(0).alias("depth"), F.coalesce("visible", F.lit(False)).alias("shown")
    )
    state, rounds = cut(state), max(1, tree.count()).bit_length()
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("path").alias("p"), F.col("layer_index").alias("i"), F.col("up").alias("up2"), F.col("full_path").alias("f2"), F.col("depth").alias("d2"), F.col("shown").alias("s2"))
        met = state.join(above, F.col("path").eqNullSafe(F.col("p")) & (F.col("up") == F.col("i")), "left")
        went = F.col("up").isNotNull()
        state = cut(met.select(
            "path", "layer_index", F.col("up2").alias("up"), F.when(went, F.concat("f2", F.lit("/"), "full_path")).otherwise(F.col("full_path")).alias("full_path"),
            F.when(went, F.col("d2") + F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.when(went, F.col("s2") & F.col("shown")).otherwise(F.col("shown")).alias("shown"),
        ))
    ended = F.col("up").isNull()
    told = state.select(F.col("path").alias("p"), F.col("layer_index").alias("i"), *[F.when(ended, F.col(c)).alias(c) for c in ("full_path", "depth", "shown")])
    return tree.join(told, F.col("path").eqNullSafe(F.col("p")) & (F.col("layer_index") == F.col("i"))).drop("p", "i")


def find_layers(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, wanted, layer_index) of the image layer that each row of `wanted` (path, wanted) names; unknown names give no row.

    Names are separated by slashes of either kind and compared without case. The first one may be that of any
    layer, the lowest in the file; each further one is that of the lowest so named layer in the group before it.
    """
    tree = cut(tree.where("layer_index IS NOT NULL").select(F.col("path").alias("p"), "layer_index", F.lower("name").alias("n"), "is_group", F.col("parent_index").alias("parent")))
    asked = cut(wanted.select("path", "wanted").distinct().withColumn("names", F.split(F.lower("wanted"), r"[/\\]")))
    longest = asked.agg(F.max(F.size("names"))).first()[0] or 0
    at = asked.withColumns({"at": F.lit(None).cast("int"), "group": F.lit(True)})
    found = None
    for k in range(longest):
        here = F.lit(True) if k == 0 else (F.col("parent") == F.col("at")) & F.col("group")
        met = at.where(F.size("names") > k).join(tree, (F.col("path") == F.col("p")) & (F.get("names", F.lit(k)) == F.col("n")) & here)
        at = cut(met.groupBy("path", "wanted", "names").agg(F.min(F.struct("layer_index", "is_group")).alias("l")).select("path", "wanted", "names", F.col("l.layer_index").alias("at"), F.col("l.is_group").alias("group")))
        done = at.where((F.size("names") == k + 1) & ~F.col("group")).select("path", "wanted", F.col("at").alias("layer_index"))
        found = done if found is None else found.unionByName(done)
    return found if found is not None else tree.where("false").select(F.col("p").alias("path"), F.lit("").alias("wanted"), "layer_index")


def layer_images(files: DataFrame, wanted: DataFrame, frame_no: int = 0) -> DataFrame:
    """Pixels (path, wanted, width, height, x, y, r, g, b, a) of the layers that `wanted` (path, wanted) names, each as large as
    the canvas: what the layer's first cel of a frame has on it, transparent elsewhere.

    Layers that `find_layers` does not find, and those without a cel in that frame, give no pixels.
    """
    files = files.select("path", "content")
    found = cut(find_layers(layers(files), wanted))
    drawn = cels(files).where(F.col("frame_no") == frame_no)
    met = drawn.join(found.select(F.col("path").alias("p"), "wanted", F.col("layer_index").alias("l")), (F.col("path") == F.col("p")) & (F.col("layer_index") == F.col("l"))).drop("p", "l")
    first = cut(met.dropDuplicates(["path", "wanted"]).select("path", "wanted", "image_width", "image_height", "cel_x", "cel_y", "width", "height", "data"))
    rows = first.where("image_width > 0 AND image_height > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("image_height") - 1)))
    canvas = rows.select("path", "wanted", F.col("image_width").alias("width"), F.col("image_height").alias("height"), F.explode(F.sequence(F.lit(0), F.col("image_width") - 1)).alias("x"), "y")
    px = unpack(first.where("width > 0 AND height > 0")).select(F.col("path").alias("p"), F.col("wanted").alias("w"), (F.col("x") + F.col("cel_x")).alias("cx"), (F.col("y") + F.col("cel_y")).alias("cy"), "r", "g", "b", "a")
    on = (F.col("path") == F.col("p")) & (F.col("wanted") == F.col("w")) & (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy"))
    return canvas.join(px, on, "left").select("path", "wanted", "width", "height", "x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"])

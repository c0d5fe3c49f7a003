"""Image files as relations: sniffing in SQL, decoding to pixels, encoding from pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codecs, imagefiles, jpeg, plain

# File extensions by format.
EXTENSIONS = {"png": (".png",), "gif": (".gif",), "jpeg": (".jpg", ".jpe", ".jpeg", ".jfif"), "bmp": (".bmp",), "targa": (".tga",)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files that arrive are read once."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bytes(content: Column, n: int = 64) -> Column:
    """The first `n` bytes as an array of numbers."""
    size = F.least(F.octet_length(content), F.lit(n))
    one = lambda i: F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), one)).otherwise(F.expr("cast(array() as array<int>)"))


def _matching(b: Column, values: bytes, at: int = 0) -> Column:
    """How many of the bytes match."""
    total = F.lit(0)
    for i, v in enumerate(values):
        total = total + F.when(F.get(b, F.lit(at + i)) == v, 1).otherwise(0)
    return total


def certainty(b: Column, size: Column) -> dict[str, Column]:
    """0 (no), 1 (maybe), 2 (probably), 3 (yes) for each format, from the first 64 bytes `b` and the file size.

    By the formats' specifications: a signature that the format prescribes is probable, with header fields in
    their ranges certain. Targa prescribes none, so fields in range make it a maybe, and with true sizes probable.
    """
    at = lambda i: F.coalesce(F.get(b, F.lit(i)), F.lit(-1))
    starts = lambda sign, i=0: _matching(b, sign, i) == len(sign)
    level = lambda signed, valid: F.when(signed & valid, 3).when(signed, 2).otherwise(0)
    word = lambda i: at(i) + 256 * at(i + 1)
    depth = at(16).isin(8, 15, 16, 24, 32)
    fields = at(1).isin(0, 1) & at(2).isin(1, 2, 3, 9, 10, 11) & depth & (word(12) > 0) & (word(14) > 0)
    mapped = (at(1) == 1) & (at(7).isin(15, 16, 24, 32)) | (at(1) == 0) & (word(3) == 0) & (word(5) == 0) & (at(7) == 0)
    out = {
        "png": level(starts(codecs.MAGIC), starts(b"\0\0\0\rIHDR", 8) & (size >= 45)),
        "gif": level(starts(b"GIF87a") | starts(b"GIF89a"), (word(6) > 0) & (word(8) > 0) & (size >= 14)),
        "jpeg": level(starts(b"\xff\xd8\xff"), starts(b"JFIF\0", 6) | starts(b"Exif\0", 6)),
        "bmp": F.when(starts(b"BM") & (size >= 26), F.when(at(14).isin(12, 40, 52, 56, 108, 124) & (at(15) == 0), 3).otherwise(1)).otherwise(0),
        "targa": F.when(fields & (size >= 18), F.when(mapped, 2).otherwise(1)).otherwise(0),
    }
    return {k: F.coalesce(v, F.lit(0)) for k, v in out.items()}


def guess_format(content: Column, path: Column | None = None, size: Column | None = None) -> Column:
    """The most certain format by content; a fitting extension breaks ties, and without any hint of the
    content the result is null. `size`: of the whole file, where `content` is its head."""

    def entry(c: Column, i: int, name: str, named: Column) -> Column:
        return _let(c, lambda v: F.struct((v * 2 + named).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name"), v.alias("c")))

    def best(b: Column) -> Column:
        scores = []
        for i, (name, c) in enumerate(certainty(b, F.octet_length(content) if size is None else size).items()):
            named = F.lit(0)
            if path is not None:
                for e in EXTENSIONS[name]:
                    named = F.greatest(named, F.when(F.lower(path).endswith(e), 1).otherwise(0))
            scores.append(entry(c, i, name, named))
        return _let(F.array_max(F.array(*scores)), lambda s: F.when(s["c"] > 0, s["name"]))

    return _let(_bytes(content), best)


def _number(data: str | Column, at: Column | int) -> Column:
    """Two bytes of `data` from place `at` (0 the first), high one first."""
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.hex(F.substring(F.col(data) if isinstance(data, str) else data, start, F.lit(2))), 16, 10).cast("long")


#: Segments of a JPEG file that are walked over in column expressions; files with more are walked in Python.
SEGMENTS = 64


def _jpeg_frame(content: Column, wanted: Column) -> Column:
    """The frame segment of a JPEG file behind its mark (length, precision, height, width, components; 8 bytes), where `wanted`; null without one.

    Most files say it behind a few segments. Those that do not, or that fill up with FF bytes, are walked to the end by
    `imagefiles.jpeg_frame`; of all others nothing reaches Python.
    """
    frames = [0xFFC0 + i for i in range(16) if i not in (4, 8, 12)]
    step = lambda p, _: F.when(_number(content, p).isin(frames), p).otherwise(p + 2 + F.coalesce(_number(content, p + 2), F.lit(0)))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), F.lit(2).cast("long"), step)
    near = _let(place, lambda p: F.when(_number(content, p).isin(frames), F.substring(content, p + 3, F.lit(8))))
    near = F.when(wanted, near)

    @F.pandas_udf("binary")
    def far(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else imagefiles.jpeg_frame(lambda at, n: c[at : at + n], len(c)))

    return F.coalesce(near, far(F.when(wanted & near.isNull(), content)))


def metadata(files: DataFrame) -> DataFrame:
    """(path, format, width, height) of (path, content) files from their heads, in column expressions; sizes beyond an int are null.

    A JPEG file says its size behind other segments, which are walked over, however many.
    """
    kind = guess_format(F.col("content"), F.col("path"))
    f = files.select("path", _bytes(F.col("content"), 32).alias("b"), kind.alias("format"), _jpeg_frame(F.col("content"), kind == "jpeg").alias("frame"))
    return _described(f).select("path", "format", "width", "height")


def head_metadata(spark: SparkSession, path: str, head: int = imagefiles.HEAD) -> DataFrame:
    """(path, length, format, width, height, color, bits) of the files under `path`, of which only ranges are read: the
    first `head` bytes, and for a JPEG file with more before its frame 4 KiB at each mark.

    color: palette, gray, gray alpha, rgb, rgba or cmyk; bits: of a pixel.
    """
    heads = imagefiles.read(spark, path, ("path", "length", "head", "frame"), head)
    f = heads.select("path", "length", _bytes(F.col("head"), 32).alias("b"), guess_format(F.col("head"), F.col("path"), F.col("length")).alias("format"), "frame")
    return _described(f).select("path", "length", "format", "width", "height", "color", "bits")


def _described(f: DataFrame) -> DataFrame:
    """`f` (b: the first bytes, format, frame) with width, height, color and bits."""
    at = lambda i: F.get("b", F.lit(i)).cast("long")
    big = lambda i: ((at(i) * 256 + at(i + 1)) * 256 + at(i + 2)) * 256 + at(i + 3)
    little = lambda i: at(i) + at(i + 1) * 256
    signed = lambda i: little(i) + (little(i + 2) - F.when(at(i + 3) >= 128, 65_536).otherwise(0)) * 65_536
    old = at(14) == 12  # the oldest header has sizes of two bytes; later ones a negative height for lines from the top
    parts = F.conv(F.hex(F.substring("frame", 8, 1)), 16, 10).cast("long")
    named = lambda v, names: F.coalesce(*[F.when(v == k, name) for k, name in names.items()])
    deep = lambda v: F.when(v <= 8, "palette").when(v == 32, "rgba").otherwise("rgb")
    samples = F.coalesce(*[F.when(at(25) == k, n) for k, n in ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4))])
    bmp_bits = F.when(old, little(24)).otherwise(little(28))
    places = {
        "png": (big(16), big(20), named(at(25), {0: "gray", 2: "rgb", 3: "palette", 4: "gray alpha", 6: "rgba"}), at(24) * samples),
        "gif": (little(6), little(8), F.lit("palette"), at(10) % 8 + 1),
        "bmp": (F.when(old, little(18)).otherwise(signed(18)), F.when(old, little(20)).otherwise(F.abs(signed(22))), deep(bmp_bits), bmp_bits),
        "targa": (little(12), little(14), F.when(at(2) % 8 == 1, "palette").when(at(2) % 8 == 3, "gray").when(at(16) == 32, "rgba").otherwise("rgb"), at(16)),
        "jpeg": (_number("frame", 5), _number("frame", 3), named(parts, {1: "gray", 3: "rgb", 4: "cmyk"}), parts * F.conv(F.hex(F.substring("frame", 3, 1)), 16, 10).cast("long")),
    }
    pick = lambda k: F.coalesce(*[F.when(F.col("format") == name, v[k]) for name, v in places.items()])
    return f.withColumns({"width": pick(0).try_cast("int"), "height": pick(1).try_cast("int"), "color": pick(2), "bits": pick(3).cast("int")})


#: Text keys with a name of their own; any other text is kept under a dot and its keyword. Fixed values.
PNG_TEXTS = ("Title", "Author", "Copyright", "Description", "Comment", "Disclaimer", "Warning", "Software")
CHROMATICITIES = ("WhitePointX", "WhitePointY", "RedX", "RedY", "GreenX", "GreenY", "BlueX", "BlueY")
INTENTS = ("Perceptual", "RelativeColorimetric", "Saturation", "AbsoluteColorimetric")


def png_metadata(files: DataFrame) -> DataFrame:
    """(path, key, value) of the notes in PNG files (path, content); of equal keys the last one counts.

    Keys are Gamma, Chromaticity..., SrgbRenderingIntent, IccpProfile (base 64), IccpProfileName, PixelsPerMeterX and Y,
    Timestamp, those of PNG_TEXTS, and "." with the keyword of other texts. Files that are no PNG give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *note) for i, content in enumerate(batch.column(1)) if content.is_valid for n, note in enumerate(codecs.png_notes(content.as_py()))]
            places, numbers, kinds, names, bodies = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int32())), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(bodies, pa.binary())],
                names=["path", "n", "kind", "name", "data"],
            )

    chunks = files.select("path", "content").mapInArrow(run, "path string, n int, kind string, name string, data binary")
    number = lambda i, size=4: F.conv(F.hex(F.substring("data", i + 1, size)), 16, 10).cast("long")
    of = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    text = F.decode("data", "UTF-8")
    key = F.concat(F.lit("."), F.col("name"))
    for known in PNG_TEXTS:
        key = F.when(F.lower("name") == known.lower(), known).otherwise(key)
    intent = F.get(F.array(*map(F.lit, INTENTS)), number(0, 1).cast("int"))
    moment = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", number(0, 2), *[number(i, 1) for i in range(2, 7)])
    entries = {
        "gAMA": [of("Gamma", number(0) / 100_000)], "sRGB": [of("SrgbRenderingIntent", intent)], "tIME": [of("Timestamp", moment)],
        "cHRM": [of(f"Chromaticity{name}", number(4 * i) / 100_000) for i, name in enumerate(CHROMATICITIES)],
        "pHYs": [of("PixelsPerMeterX", number(0)), of("PixelsPerMeterY", number(4))],
        "iCCP": [of("IccpProfile", F.base64("data")), of("IccpProfileName", F.col("name"))],
        "text": [F.struct(key.alias("key"), text.alias("value"))],
    }
    cases = F.lit(None)
    for kind, found in entries.items():
        cases = F.when(F.col("kind") == kind, F.array(*found)).otherwise(cases)
    told = chunks.select("path", "n", F.inline(cases)).where("value IS NOT NULL")
    return told.groupBy("path", "key").agg(F.max_by("value", "n").alias("value"))


def with_png_metadata(files: DataFrame, metadata: str = "metadata") -> DataFrame:
    """PNG files (…, content, `metadata` map of strings) with the notes of the map behind their header, in column
    expressions; a null map changes nothing.

    Gamma, PixelsPerMeterX and Y (both), Timestamp and texts are written, under the keys of `png_metadata`; other
    keys, and keywords that are not 1 to 79 printable ASCII characters, are left out.
    """
    m = F.col(metadata)
    four = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")

    def chunk(kind: str, body: Column) -> Column:  # body in hex
        whole = F.unhex(F.concat(F.lit(kind.encode().hex()), body))
        return F.concat(four(F.length(body) / 2), F.hex(whole), four(F.crc32(whole)))

    known = F.array(*map(F.lit, PNG_TEXTS))
    entries = F.filter(F.map_entries(m), lambda e: F.array_contains(known, e["key"]) | e["key"].rlike(r"^\.[ -~]{1,79}$"))

    def text(e: Column) -> Column:
        name = F.hex(F.encode(F.regexp_replace(e["key"], r"^\.", ""), "UTF-8"))
        value = F.hex(F.encode(F.coalesce(e["value"], F.lit("")), "UTF-8"))
        ascii = e["value"].rlike(r"^[\x01-\x7f]*$")
        return F.when(ascii, chunk("tEXt", F.concat(name, F.lit("00"), value))).otherwise(chunk("iTXt", F.concat(name, F.lit("0000000000"), value)))

    small = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    at = F.to_timestamp_ntz(m["Timestamp"])
    moment = F.concat(small(F.year(at), 4), *[small(f(at), 2) for f in (F.month, F.day, F.hour, F.minute, F.second)])
    notes = [
        chunk("gAMA", four(F.round(m["Gamma"].try_cast("double") * 100_000))),
        chunk("pHYs", F.concat(four(m["PixelsPerMeterX"].try_cast("long")), four(m["PixelsPerMeterY"].try_cast("long")), F.lit("01"))),
        chunk("tIME", moment),
        F.array_join(F.transform(entries, text), ""),
    ]
    head = F.concat(*[F.coalesce(n, F.lit("")) for n in notes])
    behind = F.concat(F.substring("content", 1, 33), F.unhex(head), F.expr("substring(content, 34)"))
    return files.withColumn("content", F.when(m.isNull(), F.col("content")).otherwise(behind))


#: Unpacked bytes of images that a task holds at once, the last image aside.
HELD_BYTES = 1 << 26


def decode(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """(path, format, width, height, data, error) for each (path, content) row: an image packed in rgba bytes, or what
    was wrong with the file. `fmt` stands for guessing by content and path."""
    chosen = F.lit(fmt) if fmt else guess_format(F.col("content"), F.col("path"))
    table, kinds = dict(codecs.LOADERS), (pa.int32(), pa.int32(), pa.binary(), pa.string())

    def one(kind: str | None, content: bytes | None) -> tuple:
        if content is None:
            return None, None, None, "no content"
        if kind not in table:
            return None, None, None, "unknown format" if kind is None else f"no loader for {kind}"
        try:
            image = table[kind](content)
        except (ValueError, IndexError, KeyError, OSError, zlib.error, struct.error) as e:
            return None, None, None, f"broken file: {e}"
        if image is None:
            return None, None, None, "unsupported variant"
        return image.shape[1], image.shape[0], np.ascontiguousarray(image).tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = 0, [], 0
            for i in range(batch.num_rows):
                rows.append(one(batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                size += len(rows[-1][2] or b"")
                if size > HELD_BYTES or i + 1 == batch.num_rows:  # memory follows neither the batch nor the task
                    new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(rows)) for c in (0, 1)), *new], names=["path", "format", "width", "height", "data", "error"])
                    at, rows, size = i + 1, [], 0

    return files.select("path", chosen.alias("format"), "content").mapInArrow(run, "path string, format string, width int, height int, data binary, error string")


def load(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """Pixels (path, width, height, x, y, r, g, b, a) of (path, content) rows; unreadable files give none, `decode`
    tells why.

    BMP and Targa, where named as `fmt`, are read in column expressions (`plain`); for other formats the decoder yields one
    packed row for an image, and pixels are unpacked by Spark.
    """
    known = {codecs.decode_bmp: plain.load_bmp, codecs.decode_targa: plain.load_targa}.get(codecs.LOADERS.get(fmt))
    if known:
        return known(files)
    return unpack(decode(files, fmt).where("error IS NULL").drop("format", "error"))


def unpack(packed: DataFrame) -> DataFrame:
    """Pixel rows of packed images (…, width, height, data: rgba bytes)."""
    lines = packed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("line", F.substring(F.col("data"), F.col("y") * F.col("width") * 4 + 1, F.col("width") * 4)).drop("data")
    p = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("h", F.hex(F.substring(F.col("line"), F.col("x") * 4 + 1, F.lit(4))))
    part = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    return p.drop("line").withColumns({c: part(i) for i, c in enumerate("rgba")}).drop("h")


def pack(df: DataFrame, key: str = "image_id", order: str = "rgba", upward: bool = False) -> DataFrame:
    """(key, width, height, data binary): row-major bytes of each image, channels as in `order`, lines from the top
    or, `upward`, from the bottom."""
    two = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    rows = df.groupBy(key, "width", "height", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.concat(*[two(c) for c in order]).alias("p")))), lambda s: s["p"]), "").alias("line"))
    whole = rows.groupBy(key, "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line")), asc=not upward), lambda s: s["line"]), "").alias("hex"))
    return whole.select(key, "width", "height", F.unhex("hex").alias("data"))


FRAME_SCHEMA = "path string, canvas_width int, canvas_height int, repeat int, comment string, frame_no int, left int, top int, delay int, disposal int, wait_key boolean, own_palette boolean, width int, height int, data binary, error string"


def decode_frames(files: DataFrame) -> DataFrame:
    """A row for each frame of GIF files (path, content), its pixels packed: path, canvas_width, canvas_height, repeat (0: for
    ever; null: not said), comment, frame_no, left, top, delay (1/100 s), disposal (0 and 1: the frame stays, 2: its place is cleared,
    3: it goes), wait_key, own_palette, width, height, data; for a file that cannot be read its path and the error."""
    fields = [f.strip().split(" ") for f in FRAME_SCHEMA.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a batch a file
                try:
                    a = codecs.gif_animation(content.as_py() or b"")
                    rows = [(path, *a[:4], k, *f[1:], f[0].shape[1], f[0].shape[0], np.ascontiguousarray(f[0]).tobytes(), None) for k, f in enumerate(a.frames)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(path, *[None] * (len(fields) - 2), f"broken file: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return files.select("path", "content").mapInArrow(run, FRAME_SCHEMA)


def load_frames(files: DataFrame) -> DataFrame:
    """Pixels of every frame of GIF files (path, content): (path, frame_no, left, top, delay, width, height, x, y, r, g,
    b, a); delay in hundredths of a second. Unreadable files give none; `decode_frames` tells why."""
    return unpack(decode_frames(files).where("error IS NULL").select("path", "frame_no", "left", "top", "delay", "width", "height", "data"))


def play(frames: DataFrame) -> DataFrame:
    """What each frame of `frames` (rows of `decode_frames`) shows: pixels (path, frame_no, delay, width, height, x, y, r, g, b, a) of the
    whole canvas.

    A frame's visible pixels lie over what the frames before left: the last pixel that one of them painted there to stay, or
    cleared. Every place of a canvas has a window of its own over the frames, so no task sees more of an animation than
    one place. Frames are clipped to their canvas; reserved disposals count as staying.
    """
    told = frames.where("error IS NULL AND canvas_width > 0 AND canvas_height > 0")
    rows = told.select("path", "frame_no", "delay", "disposal", "left", "top", F.col("width").alias("fw"), F.col("height").alias("fh"), F.col("canvas_width").alias("width"), F.col("canvas_height").alias("height"))
    grid = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    px = unpack(told.select("path", "frame_no", "left", "top", "width", "height", "data")).where("a > 0")
    px = px.select(F.col("path").alias("p"), F.col("frame_no").alias("f"), (F.col("x") + F.col("left")).alias("px"), (F.col("y") + F.col("top")).alias("py"), F.struct("r", "g", "b", "a").alias("paint"))
    met = grid.join(px, (F.col("path") == F.col("p")) & (F.col("frame_no") == F.col("f")) & (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), "left")
    clear = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    inside = F.col("x").between(F.col("left"), F.col("left") + F.col("fw") - 1) & F.col("y").between(F.col("top"), F.col("top") + F.col("fh") - 1)
    stays = F.when(F.col("disposal") == 2, F.when(inside, clear)).when(F.col("disposal") == 3, F.lit(None)).otherwise(F.col("paint"))
    before = Window.partitionBy("path", "x", "y").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    shown = met.withColumn("stays", stays).withColumn("shown", F.coalesce("paint", F.last("stays", ignorenulls=True).over(before), clear))
    return shown.select("path", "frame_no", "delay", "width", "height", "x", "y", "shown.*")


def save_frames(df: DataFrame, key: str = "image_id", repeat: int | None = 0) -> DataFrame:
    """(key, content binary): the frames (key, frame_no, delay, width, height, x, y, r, g, b, a) of each key as one
    GIF animation of at most 256 colours a frame. Columns left, top and disposal of a frame, and comment of a key, are written where they
    are there. Frames of one key are joined in one row."""
    kind = df.schema[key].dataType.simpleString()
    said = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) if c in df.columns else F.lit(0).alias(c) for c in ("left", "top", "disposal")]
    comment = F.col("comment").cast("string") if "comment" in df.columns else F.lit(None).cast("string")
    named = df.withColumn("__frame", F.struct(F.col(key).alias("key"), "frame_no", "delay", *said, comment.alias("comment")))
    frames = pack(named.select("__frame", "width", "height", "x", "y", "r", "g", "b", "a"), "__frame")
    whole = frames.groupBy(F.col("__frame.key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("__frame.frame_no", "__frame.delay", "__frame.left", "__frame.top", "__frame.disposal", "width", "height", "data"))).alias("frames"), F.max("__frame.comment").alias("comment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                codecs.encode_gif([(np.frombuffer(f["data"], np.uint8).reshape(f["height"], f["width"], 4), f["delay"], f["left"], f["top"], f["disposal"]) for f in frames], repeat, said)
                for frames, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "content"])

    return whole.mapInArrow(run, f"{key} {kind}, content binary")


def _little(v: Column | int, n: int) -> Column:
    """Hex of the `n` low bytes of a number, lowest first."""
    h = F.lpad(F.hex((F.lit(v) if isinstance(v, int) else v).cast("long")), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(n)])


def _bmp_head(width: Column, height: Column, size: Column) -> Column:
    """Hex of a file header and a V4 header: 32 bits, bit fields, sRGB."""
    fields = [(size + 122, 4), (0, 4), (122, 4), (108, 4), (width, 4), (height, 4), (1, 2), (32, 2), (3, 4), (size, 4), (2835, 4), (2835, 4), (0, 8), (0xFF0000, 4), (0xFF00, 4), (0xFF, 4), (0xFF000000, 4)]
    return F.concat(F.lit("424D"), *[_little(v, n) for v, n in fields], F.lit(b"BGRs".hex() + "00" * 48))


def _targa_head(width: Column, height: Column, size: Column) -> Column:
    """Hex of a header for 32 bits without a palette, lines from the bottom."""
    return F.concat(F.lit("000002" + "00" * 9), _little(width, 2), _little(height, 2), F.lit("2008"))


#: Header of the formats that need no coding, by the saver that stands for it in the table of formats.
_PLAIN = {codecs.encode_bmp: _bmp_head, codecs.encode_targa: _targa_head}


def save(df: DataFrame, fmt: str, key: str = "image_id") -> DataFrame:
    """(key, content binary): every image as a file of format `fmt`; unknown formats raise.

    BMP and Targa are written in column expressions; only compressing formats and registered ones run in Python.
    JPEG goes through `save_jpeg`, PNG through `save_png`.
    """
    if fmt not in codecs.SAVERS:
        raise ValueError(f"no saver for {fmt}")
    encode, kind = codecs.SAVERS[fmt], df.schema[key].dataType.simpleString()
    if encode is jpeg.encode:
        return save_jpeg(df, key)
    if encode is codecs.encode_png:
        return save_png(df, key)
    if encode in _PLAIN:
        head = F.unhex(_PLAIN[encode](F.col("width"), F.col("height"), F.octet_length("data")))
        return pack(df, key, "bgra", upward=True).select(key, F.concat(head, "data").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [encode(np.frombuffer(d, np.uint8).reshape(h, w, 4)) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
            yield pdf[[key, "content"]]

    return pack(df, key).mapInPandas(run, f"{key} {kind}, content binary")


def save_png(df: DataFrame, key: str = "image_id", alpha: bool = True, band: int = 64, level: int = 6) -> DataFrame:
    """(key, content binary): every image as a PNG file of true colour, with alpha if asked.

    Tasks filter and deflate bands of `band` lines, each with the line above it, so an image needs no single task until its coded
    bands are joined. Each band ends on a byte and looks back at no other; the checksum of all lines is combined from the bands' own.
    """
    kind, order = df.schema[key].dataType.simpleString(), "rgba" if alpha else "rgb"
    n = len(order)
    here = F.floor(F.col("y") / band).cast("int")
    below = (F.col("y") % band == band - 1) & (F.col("y") + 1 < F.col("height"))  # the line above the next band
    dealt = df.withColumn("__at", F.explode(F.when(below, F.array(here, here + 1)).otherwise(F.array(here))))
    named = dealt.withColumn("__band", F.struct(F.col(key).alias("key"), F.col("__at").alias("band")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, w, h, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                rows = np.frombuffer(data, np.uint8).reshape(-1, w * n)
                above, rows = (rows[0], rows[1:]) if k else (np.zeros(w * n, np.uint8), rows)
                out.append(codecs.png_band(rows, above, n, k == 0, (k + 1) * band >= h, level))
            parts, sums, lengths = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(parts, pa.binary()), pa.array(sums, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "band", "width", "height", "part", "sum", "length"])

    bands = pack(named, "__band", order).select("__band.key", "__band.band", "width", "height", "data")
    coded = bands.mapInArrow(run, f"key {kind}, band int, width int, height int, part binary, sum long, length long")
    whole = coded.groupBy("key", "width", "height").agg(F.sort_array(F.collect_list(F.struct("band", F.hex("part").alias("part"), "sum", "length"))).alias("bands"))
    # Of two texts one behind the other: the low halves add up, and the high half of the first grows by its low half with each byte of the second.
    m = 65_521

    def after(a: Column, b: Column) -> Column:
        low = (a % 65_536 + b["sum"] % 65_536 + m - 1) % m
        high = (F.floor(a / 65_536) + F.floor(b["sum"] / 65_536) + (b["length"] % m) * (a % 65_536 + m - 1)) % m
        return high * 65_536 + low

    four = lambda v: F.lpad(F.hex(v.cast("long")), 8, "0")
    chunk = lambda name, body: F.concat(four(F.length(body) / 2), F.lit(name.encode().hex()), body, four(F.crc32(F.unhex(F.concat(F.lit(name.encode().hex()), body)))))
    head = F.concat(four(F.col("width")), four(F.col("height")), F.lit(f"08{6 if alpha else 2:02d}000000"))
    check = chunk("IDAT", four(F.aggregate("bands", F.lit(1).cast("long"), after)))
    body = F.array_join(F.transform("bands", lambda b: b["part"]), "")
    return whole.select(F.col("key").alias(key), F.unhex(F.concat(F.lit(codecs.MAGIC.hex()), chunk("IHDR", head), body, check, chunk("IEND", F.lit("")))).alias("content"))


def _bands(df: DataFrame, key: str) -> DataFrame:
    """(key, band, width, height, data): red, green and blue of eight lines a row, from the top."""
    named = df.withColumn("__band", F.struct(F.col(key).alias("key"), F.floor(F.col("y") / 8).cast("int").alias("band")))
    return pack(named, "__band", "rgb").select("__band.key", "__band.band", "width", "height", "data")


def jpeg_coefficients(df: DataFrame, key: str = "image_id", quality: int = 85) -> DataFrame:
    """(key, band, block, channel, k, v): what `save_jpeg` codes, the quantized waves that are not zero.

    A band is eight lines, a block eight columns of it, channel 0 brightness and 1, 2 the colours, k = 8 * v + u.
    """
    kind, tables = df.schema[key].dataType.simpleString(), jpeg.quantizers(quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, data = batch.column(2)[i].as_py(), batch.column(4)[i].as_py()
                found = jpeg.coefficients(np.frombuffer(data, np.uint8).reshape(-1, w, 3), tables)
                at = np.nonzero(found)
                rows = [pa.array(a.astype(np.int32)) for a in (*at, found[at])]
                same = [batch.column(c).take(pa.array(np.full(len(at[0]), i))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *rows], names=["key", "band", "block", "channel", "k", "v"])

    return _bands(df, key).mapInArrow(run, f"key {kind}, band int, block int, channel int, k int, v int").withColumnRenamed("key", key)


def save_jpeg(df: DataFrame, key: str = "image_id", quality: int = 85) -> DataFrame:
    """(key, content binary): every image as a baseline JPEG file of a quality from 1 to 100; alpha is left out.

    Tasks code bands of eight lines, so an image needs no single task until its coded bands are joined. Images with a
    side over 65,535, which the format cannot say, get null content.
    """
    kind, tables = df.schema[key].dataType.simpleString(), jpeg.quantizers(quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
            coded = [None if data is None else jpeg.band(jpeg.coefficients(np.frombuffer(data, np.uint8).reshape(-1, w, 3), tables)) for w, data in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(coded, pa.binary())], names=["key", "band", "width", "height", "coded"])

    fits = (F.col("width") <= jpeg.LONGEST) & (F.col("height") <= jpeg.LONGEST)
    bands = _bands(df, key).withColumn("data", F.when(fits, F.col("data")))
    coded = bands.mapInArrow(run, f"key {kind}, band int, width int, height int, coded binary")
    mark = F.when((F.col("band") + 1) * 8 < F.col("height"), F.concat(F.lit("FF"), F.hex((F.col("band") % 8 + 0xD0).cast("long")))).otherwise("")
    whole = coded.withColumn("part", F.concat(F.hex("coded"), mark)).groupBy("key", "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "part"))), lambda b: b["part"]), "").alias("body"))
    first, second, third = (F.lit(h.hex()) for h in jpeg.heads(quality))
    big = lambda v: F.lpad(F.hex(v.cast("long")), 4, "0")
    head = F.concat(first, big(F.col("height")), big(F.col("width")), second, big(F.floor((F.col("width") + 7) / 8)), third)
    return whole.select(F.col("key").alias(key), F.when(fits, F.unhex(F.concat(head, "body", F.lit("FFD9")))).alias("content"))


def read_with_jvm(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the files under `path` by Spark's own image source; this is the way to read JPEG.

    The source hands over rows of B, G, R(, A) bytes or of one gray byte; unreadable files are dropped.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    line = F.substring(F.col("data"), F.col("y") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels"))
    rows = raw.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("line", line).drop("data")
    p = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("h", F.hex(F.substring(F.col("line"), F.col("x") * F.col("nChannels") + 1, F.col("nChannels"))))
    part = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    one = F.col("nChannels") == 1
    return p.select(
        F.col("origin").alias("path"), "width", "height", "x", "y", F.when(one, part(0)).otherwise(part(2)).alias("r"), F.when(one, part(0)).otherwise(part(1)).alias("g"),
        part(0).alias("b"), F.when(F.col("nChannels") == 4, part(3)).otherwise(255).alias("a"),
    )

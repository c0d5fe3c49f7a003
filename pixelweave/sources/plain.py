"""Uncompressed image files, BMP and Targa, read in column expressions.

The header of a file gives the place of every line in it; lines are cut out of the content, one row each, and pixels out of
their line. Nothing leaves the JVM, and an image is spread over as many tasks as its lines are dealt to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("path", "width", "height", "x", "y", "r", "g", "b", "a")


def _little(data: Column | str, at: Column | int, n: int) -> Column:
    """The number in `n` bytes from place `at` (0 the first), lowest byte first; null behind the end."""
    start = at.cast("int") + 1 if isinstance(at, Column) else F.lit(at + 1)
    h = F.hex(F.substring(F.col(data) if isinstance(data, str) else data, start, F.lit(n)))
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("long"))


def _signed(v: Column) -> Column:
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def _byte(data: str, at: Column | int) -> Column:
    return _little(data, at, 1)


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def bmp_headers(files: DataFrame) -> DataFrame:
    """(path, content, width, height, down, depth, row, at, used, palette, masks, error) of (path, content) files: `down` for lines from
    the top, `row` bytes a line, `at` the first one, the palette's bytes and the masks of red, green, blue and alpha."""
    c = F.col("content")
    size, w, h, depth, coding = _little(c, 14, 4), _signed(_little(c, 18, 4)), _signed(_little(c, 22, 4)), _little(c, 28, 2), _little(c, 30, 4)
    f = files.select("path", "content", size.alias("size"), w.alias("width"), h.alias("h"), depth.alias("depth"), coding.alias("coding"), _little(c, 10, 4).alias("at"), _little(c, 46, 4).alias("said"))
    f = f.withColumns({"height": F.abs("h"), "down": F.col("h") < 0, "row": F.ceil(F.col("width") * F.col("depth") / 32) * 4, "used": F.when(F.col("said") > 0, F.col("said")).when(F.col("depth").isin(1, 4, 8), F.pow(F.lit(2), F.col("depth")).cast("long"))})
    fields = F.when(F.col("coding") == 3, F.array(*[_little("content", 54 + 4 * i, 4) if i < 3 else F.when(F.col("size") >= 56, _little("content", 66, 4)).otherwise(0) for i in range(4)]))
    known = F.when(F.col("depth") == 16, F.array(*[F.lit(v).cast("long") for v in (0x7C00, 0x3E0, 0x1F, 0)])).otherwise(F.array(*[F.lit(v).cast("long") for v in (0xFF0000, 0xFF00, 0xFF, 0)]))
    f = f.withColumns({"masks": F.when(F.col("depth").isin(16, 32), F.coalesce(fields, known)).otherwise(known), "palette": F.when(F.col("depth") <= 8, F.substring("content", (F.col("size") + 15).cast("int"), (F.col("used") * 4).cast("int")))})
    other = (F.col("width") <= 0) | (F.col("height") == 0) | ~F.col("coding").isin(0, 3) | ~F.col("depth").isin(1, 4, 8, 16, 24, 32)
    short = (F.octet_length("content") < F.col("at") + F.col("row") * F.col("height")) | (F.octet_length("palette") < F.col("used") * 4)
    error = F.when(c.isNull(), "no content").when(F.coalesce(F.hex(F.substring(c, 1, 2)) != "424D", F.lit(True)) | F.col("said").isNull(), "broken file: no BMP header").when(other, "unsupported variant").when(short, "broken file: it ends too early")
    return f.withColumn("error", error).select("path", "content", "width", "height", "down", "depth", "row", "at", "used", "palette", "masks", "error")


def _lines(headers: DataFrame, row: Column, at: Column) -> DataFrame:
    """A row for each line as it lies in the file, number `line`, its bytes in `bytes`. Broken files go behind the explosion: a
    filter before it would be pushed into the header, and repeat its expressions."""
    lines = headers.withColumn("line", F.explode_outer(F.when(F.col("error").isNull(), _upto(F.col("height"))))).where("line IS NOT NULL")
    return lines.withColumn("bytes", F.substring("content", (at + row * F.col("line") + 1).cast("int"), row.cast("int"))).drop("content")


def load_bmp(files: DataFrame) -> DataFrame:
    """Pixels (path, width, height, x, y, r, g, b, a) of BMP files (path, content) of 1, 4, 8, 16, 24 or 32 bits, with bit fields, lines from
    the bottom or the top. Files that `bmp_headers` finds an error in give none; an index beyond the palette is black.

    Whatever the depth, a pixel becomes the number of its bytes, or of its palette entry's, and masks take the channels out of it.
    """
    low = F.transform("masks", lambda m: F.greatest(m.bitwiseAND(-m), F.lit(1)))
    heads = bmp_headers(files).withColumn("low", low).withColumn("full", F.transform("masks", lambda m, i: F.greatest(F.floor(m / F.get("low", i)), F.lit(1))))
    lines = _lines(heads, F.col("row"), F.col("at")).drop("row", "at", "used", "error")
    p = lines.withColumn("y", F.when(F.col("down"), F.col("line")).otherwise(F.col("height") - 1 - F.col("line"))).withColumn("x", F.explode_outer(_upto(F.col("width"))))
    place, step = F.col("x") * F.col("depth"), (F.col("depth") / 8).cast("int")
    shift = F.pow(F.lit(2), 8 - F.col("depth") - place % 8)
    index = F.floor(_byte("bytes", F.floor(place / 8)) / shift) % F.pow(F.lit(2), F.col("depth"))
    p = p.withColumn("index", F.when(F.col("depth") <= 8, index.cast("int")))
    part = F.when(F.col("depth") <= 8, F.substring("palette", F.col("index") * 4 + 1, F.lit(4))).otherwise(F.substring("bytes", F.col("x") * step + 1, step))
    p = p.withColumn("h", F.rpad(F.hex(part), 8, "0"))
    p = p.withColumn("v", F.conv(F.concat(*[F.substring("h", i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long"))
    get = lambda c, k: F.get(c, F.lit(k))
    channel = lambda k: F.when(get("masks", k) == 0, 255).otherwise(F.floor(F.floor(F.col("v").bitwiseAND(get("masks", k)) / get("low", k)) * 255 / get("full", k))).cast("int")
    whole = {c: F.col(c).cast("int") for c in ("width", "height", "x", "y")}
    return p.withColumns({c: channel(k) for k, c in enumerate("rgba")}).withColumns(whole).select(*PIXEL)


def targa_headers(files: DataFrame) -> DataFrame:
    """(path, content, width, height, kind, depth, wide, at, first, palette, bits, right, down, error) of (path, content) files: `wide` bytes a
    pixel, the palette's bytes and the bits of its entries, `right` for lines from the right, `down` for lines from the top."""
    b = lambda i: _byte("content", i)
    two = lambda i: _little("content", i, 2)
    f = files.select("path", "content", b(0).alias("id"), b(2).alias("kind"), two(3).alias("first"), two(5).alias("count"), b(7).alias("bits"), two(12).alias("width"), two(14).alias("height"), b(16).alias("depth"), b(17).alias("flags"))
    f = f.withColumns({"step": F.ceil(F.col("bits") / 8), "wide": F.ceil(F.col("depth") / 8), "right": F.col("flags").bitwiseAND(16) > 0, "down": F.col("flags").bitwiseAND(32) > 0})
    f = f.withColumn("palette", F.substring("content", (F.col("id") + 19).cast("int"), (F.col("count") * F.col("step")).cast("int"))).withColumn("at", F.col("id") + 18 + F.col("count") * F.col("step"))
    deep = F.when(F.col("kind") == 1, F.col("depth").isin(8, 16) & F.col("bits").isin(15, 16, 24, 32)).when(F.col("kind") == 2, F.col("depth").isin(15, 16, 24, 32)).otherwise(F.col("depth") == 8)
    other = ~F.col("kind").isin(1, 2, 3) | (F.col("width") == 0) | (F.col("height") == 0) | ~deep
    short = F.octet_length("content") < F.col("at") + F.col("width") * F.col("height") * F.col("wide")
    error = F.when(F.col("content").isNull(), "no content").when(F.col("flags").isNull(), "broken file: no Targa header").when(other, "unsupported variant").when(short, "broken file: it ends too early")
    return f.withColumn("error", error).select("path", "content", "width", "height", "kind", "depth", "wide", "at", "first", "palette", "bits", "right", "down", "error")


def load_targa(files: DataFrame) -> DataFrame:
    """Pixels (path, width, height, x, y, r, g, b, a) of uncompressed Targa files (path, content): palettes, true colour of 15, 16, 24 or 32
    bits and gray, of any origin. Files that `targa_headers` finds an error in give none; an index beyond the palette is black."""
    lines = _lines(targa_headers(files), F.col("width") * F.col("wide"), F.col("at"))
    p = lines.withColumn("y", F.when(F.col("down"), F.col("line")).otherwise(F.col("height") - 1 - F.col("line"))).withColumn("k", F.explode_outer(_upto(F.col("width"))))
    index = F.when(F.col("wide") == 1, _byte("bytes", F.col("k"))).otherwise(_little("bytes", F.col("k") * 2, 2)) - F.col("first")
    mapped = F.col("kind") == 1
    size = F.when(mapped, F.col("bits")).otherwise(F.col("depth"))
    step = F.ceil(size / 8)
    source = F.when(mapped, F.substring("palette", (index * step + 1).cast("int"), step.cast("int"))).otherwise(F.substring("bytes", (F.col("k") * F.col("wide") + 1).cast("int"), F.col("wide").cast("int")))
    p = p.withColumns({"size": size, "entry": F.when(~mapped | (index >= 0), source)})
    word = _little("entry", 0, 2)
    five = lambda k: F.floor(word / (1 << (10 - 5 * k))) % 32

    def channel(k: int) -> Column:
        small = F.lit(255) if k == 3 else five(k) * 8 + F.floor(five(k) / 4)
        true = F.when(F.col("size") == 32, _byte("entry", 3)).otherwise(255) if k == 3 else _byte("entry", 2 - k)
        gray = F.lit(255) if k == 3 else _byte("entry", 0)
        found = F.when(F.col("kind") == 3, gray).when(F.col("size").isin(15, 16), small).otherwise(true)
        return F.coalesce(found, F.lit(255 if k == 3 else 0)).cast("int")

    whole = {c: F.col(c).cast("int") for c in ("width", "height", "x", "y")}
    p = p.withColumn("x", F.when(F.col("right"), F.col("width") - 1 - F.col("k")).otherwise(F.col("k")))
    return p.withColumns({c: channel(k) for k, c in enumerate("rgba")}).withColumns(whole).select(*PIXEL)

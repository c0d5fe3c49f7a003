"""Queries of packing, codecs and sniffing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..operators import palette as Q
from ..functions.lineage import scratch
from ..functions.named import palettes
from ..sources import files as L
from ..sources import fixtures as X
from ..sources import codecs, imagefiles, jpeg, sprites

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def _round_trip(fmt: str) -> Callable:
    def run(spark, d):
        files = L.save(X.rgba(spark, d), fmt).select(F.col("image_id").cast("string").alias("path"), "content")
        return L.load(files, fmt).select(F.col("path").cast("long").alias("image_id"), "width", "height", "x", "y", "r", "g", "b", "a")

    return run


for _number, _fmt in (("b12", "png"), ("b16", "bmp"), ("b24", "targa")):
    QUERIES[f"{_number}_{_fmt}_round_trip"] = _round_trip(_fmt)
    ORACLE_SQL[f"{_number}_{_fmt}_round_trip"] = f"WITH {X.RGBA_SQL} SELECT image_id, width, height, x, y, r, g, b, a FROM px"


def _gif(spark, d):
    """Palette images through GIF files and back."""
    indexed = Q.expand(X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int")), palettes()["ega64"])
    files = L.save(indexed, "gif").select(F.col("image_id").cast("string").alias("path"), "content")
    return L.load(files, "gif").select(F.col("path").cast("long").alias("image_id"), "x", "y", "r", "g", "b")


QUERIES["b18_gif_round_trip"] = _gif
_EGA = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(palettes()["ega64"][:16]))
ORACLE_SQL["b18_gif_round_trip"] = f"WITH {X.GRAY_SQL}, pal(i, r, g, b) AS (VALUES {_EGA}) SELECT image_id, x, y, r, g, b FROM gy JOIN pal ON i = v // 16"


def _animation(spark, d):
    """Two images at a time as the frames of an animation, through GIF files and back."""
    one = Q.expand(X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int")), palettes()["ega64"])
    frames = one.withColumn("frame_no", (F.col("image_id") % 2).cast("int")).withColumn("delay", (5 + F.col("image_id") % 7).cast("int")).withColumn("image_id", F.floor(F.col("image_id") / 2).cast("long"))
    files = L.save_frames(frames).select(F.col("image_id").cast("string").alias("path"), "content")
    return L.load_frames(files).select(F.col("path").cast("long").alias("image_id"), "frame_no", "delay", "left", "top", "width", "height", "x", "y", "r", "g", "b")


QUERIES["b22_gif_frames"] = _animation
ORACLE_SQL["b22_gif_frames"] = f"""WITH {X.GRAY_SQL}, pal(i, r, g, b) AS (VALUES {_EGA}), n AS (SELECT image_id // 2 AS id, min(image_id) AS low FROM (SELECT DISTINCT image_id FROM gy) GROUP BY 1)
SELECT id AS image_id, CAST(gy.image_id - low AS INT) AS frame_no, CAST(5 + gy.image_id % 7 AS INT) AS delay, 0 AS "left", 0 AS top, 8 AS width, 8 AS height, x, y, r, g, b FROM gy JOIN n ON id = gy.image_id // 2 JOIN pal ON i = v // 16"""
QUERIES["a11_pack"] = lambda spark, d: L.pack(X.rgba(spark, d)).select("image_id", F.lower(F.hex("data")).alias("bytes"))
ORACLE_SQL["a11_pack"] = f"WITH {X.RGBA_SQL} SELECT image_id, string_agg(printf('%02x%02x%02x%02x', r, g, b, a), '' ORDER BY y, x) AS bytes FROM px GROUP BY image_id"


def _sniff(spark, d):
    """Formats and sizes of the encoded images, with texts of documents as negatives."""
    px = X.rgba(spark, d)
    files = None
    for fmt in ("png", "bmp", "targa", "jpeg"):
        one = L.save(px, fmt).select(F.concat(F.lit(f"{fmt}/"), F.col("image_id").cast("string")).alias("path"), "content")
        files = one if files is None else files.unionByName(one)
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("text/"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.concat(F.lit("~" * 20), F.col("text")), "UTF-8").alias("content"))
    return L.metadata(files.unionByName(texts))


QUERIES["b4_sniff"] = _sniff
ORACLE_SQL["b4_sniff"] = """SELECT f || '/' || vec_id AS path, f AS format, 8 AS width, 2 AS height FROM embeddings, (SELECT unnest(['png', 'bmp', 'targa', 'jpeg']) AS f)
UNION ALL SELECT 'text/' || doc_id, NULL, NULL, NULL FROM documents"""


QUERIES["b27_jpeg_coefficients"] = lambda spark, d: L.jpeg_coefficients(X.rgba(spark, d), quality=90).select("image_id", "channel", "k", "v")
_DIVISORS = ", ".join(f"({int(c > 0)}, {c}, {k}, {q})" for c in range(3) for k, q in enumerate(jpeg.quantizers(90)[int(c > 0)].tolist()))
#: Every image is one block, whose lower six lines repeat its second one.
ORACLE_SQL["b27_jpeg_coefficients"] = f"""WITH {X.RGBA_SQL}, q(t, channel, k, divisor) AS (VALUES {_DIVISORS}),
c AS MATERIALIZED (SELECT u, i, CASE u WHEN 0 THEN sqrt(0.5) ELSE 1 END / 2 * cos((2 * i + 1) * u * pi() / 16) AS f FROM range(8) AS a(u), range(8) AS b(i)),
s AS (SELECT image_id, x, y, unnest([0, 1, 2]) AS channel, unnest([0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b - 128, (b - 0.299::DOUBLE * r - 0.587::DOUBLE * g - 0.114::DOUBLE * b) / 1.772::DOUBLE, (r - 0.299::DOUBLE * r - 0.587::DOUBLE * g - 0.114::DOUBLE * b) / 1.402::DOUBLE]) AS v FROM px),
across AS MATERIALIZED (SELECT image_id, channel, y, u, sum(v * f) AS v FROM s JOIN c ON i = x GROUP BY ALL),
waves AS (SELECT image_id, channel, 8 * c.u + across.u AS k, sum(v * f) AS v FROM across JOIN c ON least(i, 1) = y GROUP BY ALL),
found AS (SELECT image_id, channel, k, CAST(floor(v / divisor + 0.5 + 1e-6) AS INT) AS v FROM waves JOIN q USING (channel, k))
SELECT image_id, CAST(channel AS INT) AS channel, CAST(k AS INT) AS k, v FROM found WHERE v <> 0"""


def _notes(spark, d):
    """Notes of every image, through PNG files and back."""
    i = F.col("image_id")
    notes = {
        "Title": F.concat(F.lit("image "), i.cast("string")), "Comment": F.concat(F.lit("größer als "), (i - 1).cast("string")), ".Origin": F.lit("embeddings"), "Gamma": ((i % 7 + 1) / 8).cast("string"),
        "PixelsPerMeterX": (i + 100).cast("string"), "PixelsPerMeterY": (i + 200).cast("string"), "Timestamp": F.concat(F.lit("2024-02-29T03:04:"), F.lpad((i % 60).cast("string"), 2, "0")),
    }
    files = L.save(X.rgba(spark, d), "png").withColumn("metadata", F.create_map(*[c for k, v in notes.items() for c in (F.lit(k), v)]))
    return L.png_metadata(L.with_png_metadata(files).withColumn("path", i.cast("string"))).select(F.col("path").cast("long").alias("image_id"), "key", "value")


QUERIES["b13_png_metadata"] = _notes
ORACLE_SQL["b13_png_metadata"] = """SELECT vec_id AS image_id, unnest(['Title', 'Comment', '.Origin', 'Gamma', 'PixelsPerMeterX', 'PixelsPerMeterY', 'Timestamp']) AS key,
unnest(['image ' || vec_id, 'größer als ' || (vec_id - 1), 'embeddings', CAST((vec_id % 7 + 1) / 8.0::DOUBLE AS VARCHAR), CAST(vec_id + 100 AS VARCHAR), CAST(vec_id + 200 AS VARCHAR), '2024-02-29T03:04:' || lpad(CAST(vec_id % 60 AS VARCHAR), 2, '0')]) AS value FROM embeddings"""


def _sprites(spark, d):
    """A sprite file of each image: an uncompressed cel on a named layer, a second frame linked to it, and a tag."""
    hexes = lambda *fields: F.concat(*[L._little(v, n) for v, n in fields])
    half = lambda c: F.octet_length(F.unhex(c))
    chunk = lambda kind, body: F.concat(hexes((half(body) + 6, 4), (kind, 2)), body)
    word = lambda t: F.concat(hexes((len(t), 2)), F.lit(t.encode().hex()))
    i = F.col("image_id")
    layer = chunk(sprites.LAYER, F.concat(hexes((1, 2), (0, 8), (0, 2), (255, 1), (0, 3)), word("ink")))
    cel = chunk(sprites.CEL, F.concat(hexes((0, 2), (F.pmod(i, F.lit(9)) - 4, 2), (3, 2), (F.pmod(i, F.lit(256)), 1), (0, 2), (0, 7), (F.col("width"), 2), (F.col("height"), 2)), F.hex("data")))
    link = chunk(sprites.CEL, hexes((0, 2), (0, 2), (0, 2), (255, 1), (1, 2), (0, 7), (0, 2)))
    tag = chunk(sprites.TAGS, F.concat(hexes((1, 2), (0, 8), (0, 2), (1, 2), (2, 1), (0, 8), (0, 4)), word("run")))
    frame = lambda n, ms, body: F.concat(hexes((half(body) + 16, 4), (sprites.FRAME_MAGIC, 2), (n, 2), (ms, 2), (0, 2), (n, 4)), body)
    frames = F.concat(frame(3, 100, F.concat(layer, tag, cel)), frame(1, F.pmod(i, F.lit(50)) + 1, link))
    head = hexes((half(frames) + 128, 4), (sprites.MAGIC, 2), (2, 2), (F.col("width"), 2), (F.col("height"), 2), (32, 2))
    return L.pack(X.rgba(spark, d)).select(i.cast("string").alias("path"), F.unhex(F.concat(head, F.lit("00" * (128 - 14)), frames)).alias("content"))


QUERIES["b29_sprite_cels"] = lambda spark, d: L.unpack(sprites.cels(_sprites(spark, d))).select(
    F.col("path").cast("long").alias("image_id"), "frame_no", "duration_ms", "layer_name", "layer_visible", "cel_x", "cel_y", "opacity", "width", "height", "x", "y", "r", "g", "b", "a"
)
ORACLE_SQL["b29_sprite_cels"] = f"""WITH {X.RGBA_SQL}, f AS (SELECT CAST(unnest([0, 1]) AS INT) AS frame_no)
SELECT image_id, frame_no, CAST(CASE frame_no WHEN 0 THEN 100 ELSE image_id % 50 + 1 END AS INT) AS duration_ms, 'ink' AS layer_name, true AS layer_visible, CAST(CASE frame_no WHEN 0 THEN image_id % 9 - 4 ELSE 0 END AS INT) AS cel_x,
  CASE frame_no WHEN 0 THEN 3 ELSE 0 END AS cel_y, CAST(CASE frame_no WHEN 0 THEN image_id % 256 ELSE 255 END AS INT) AS opacity, width, height, x, y, r, g, b, a FROM px, f"""
QUERIES["b29_sprite_tags"] = lambda spark, d: sprites.tags(_sprites(spark, d)).select(F.col("path").cast("long").alias("image_id"), "name", "first_frame", "last_frame", "direction")
ORACLE_SQL["b29_sprite_tags"] = "SELECT vec_id AS image_id, 'run' AS name, 0 AS first_frame, 1 AS last_frame, 2 AS direction FROM embeddings"


def _written(spark, d, formats: tuple[str, ...], quality: int = 85) -> str:
    """A new folder with every image as a file of each format, in the sink's names."""
    px, folder = X.rgba(spark, d), scratch(spark, "images")
    for fmt in formats:
        saved = L.save_jpeg(px, quality=quality) if fmt == "jpeg" else L.save(px, fmt)
        imagefiles.write(saved.select(F.concat(F.lit(f"{fmt}/"), F.col("image_id").cast("string"), F.lit(L.EXTENSIONS[fmt][0])).alias("path"), "content"), folder)
    return folder


def _image_id():
    return F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("image_id")


def _heads(spark, d):
    """Image files through the sink, and what their heads say through the source; sizes of files and ranges stand for the whole reading."""
    folder = _written(spark, d, ("png", "bmp", "targa", "jpeg"))
    told = L.head_metadata(spark, folder).select(_image_id(), "format", "width", "height", "color", "bits", "path")
    ranges = imagefiles.read(spark, folder, ("path", "length", "frame", "bytes_read")).select(F.col("path").alias("p"), (F.col("bytes_read") <= F.least("length", F.lit(imagefiles.HEAD))).alias("by_ranges"))
    return told.join(ranges, F.col("path") == F.col("p")).drop("path", "p")


QUERIES["b3_head_metadata"] = _heads
ORACLE_SQL["b3_head_metadata"] = """SELECT vec_id AS image_id, f AS format, 8 AS width, 2 AS height, CASE f WHEN 'jpeg' THEN 'rgb' ELSE 'rgba' END AS color, CASE f WHEN 'jpeg' THEN 24 ELSE 32 END AS bits, true AS by_ranges
FROM embeddings, (SELECT unnest(['png', 'bmp', 'targa', 'jpeg']) AS f)"""


def _loaded(spark, d):
    """Files of one kind out of a folder with several, found by a filter on names that the source answers."""
    files = imagefiles.read(spark, _written(spark, d, ("png", "targa")), ("path", "content")).where(F.col("path").endswith(".tga"))
    return L.load(files).select(_image_id(), "width", "height", "x", "y", "r", "g", "b", "a")


QUERIES["b1_load_files"] = _loaded
ORACLE_SQL["b1_load_files"] = f"WITH {X.RGBA_SQL} SELECT image_id, width, height, x, y, r, g, b, a FROM px"


def _jpeg_read(spark, d):
    """Pictures of one colour each, through JPEG files and Spark's own reader: the largest error of a channel is small."""
    flat = X.rgba(spark, d).withColumns({c: F.pmod(F.col("image_id") * k, F.lit(256)).cast("int") for c, k in zip("rgb", (37, 11, 5), strict=True)})
    folder = scratch(spark, "jpeg")
    imagefiles.write(L.save_jpeg(flat, quality=100).select(F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"), "content"), folder)
    back = L.read_with_jvm(spark, folder).select(_image_id(), "width", "height", "x", "y", "r", "g", "b")
    i = F.col("image_id")
    off = F.greatest(*[F.abs(F.col(c) - F.pmod(i * k, F.lit(256))) for c, k in zip("rgb", (37, 11, 5), strict=True)])
    return back.groupBy("image_id", "width", "height").agg(F.count(F.lit(1)).alias("n"), (F.max(off) <= 3).alias("close"))


QUERIES["b26_jpeg_read"] = _jpeg_read
ORACLE_SQL["b26_jpeg_read"] = "SELECT vec_id AS image_id, 8 AS width, 2 AS height, 16 AS n, true AS close FROM embeddings"


def pam_of(image) -> bytes:
    """A portable arbitrary map: a header of text lines, then the channels."""
    return f"P7\nWIDTH {image.shape[1]}\nHEIGHT {image.shape[0]}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".encode() + image.tobytes()


def pam_image(data: bytes):
    head, body = data.split(b"ENDHDR\n", 1)
    said = dict(line.split(b" ", 1) for line in head.splitlines()[1:])
    return np.frombuffer(body, np.uint8).reshape(int(said[b"HEIGHT"]), int(said[b"WIDTH"]), 4)


def _registered(spark, d):
    """A format of the user's own is registered, written, read and taken out again; the lists of formats follow."""
    before = imagefiles.formats()
    codecs.register("pam", pam_image, pam_of)
    try:
        during = imagefiles.formats()
        files = L.save(X.rgba(spark, d), "pam").select(F.col("image_id").cast("string").alias("path"), "content")
        out = L.load(files, "pam").select(F.col("path").cast("long").alias("image_id"), "x", "y", "r", "g", "b", "a")
    finally:
        codecs.register("pam", None, None)
    told = [during.get("pam") == (True, True), "pam" not in imagefiles.formats() and imagefiles.formats() == before]
    return out.withColumns({"listed": F.lit(told[0]), "removed": F.lit(told[1])})


QUERIES["b6_registered_format"] = _registered
ORACLE_SQL["b6_registered_format"] = f"WITH {X.RGBA_SQL} SELECT image_id, x, y, r, g, b, a, true AS listed, true AS removed FROM px"


def _layered(spark, d):
    """A sprite file of each image: a group in a group, a layer in the inner one, one beside it and one of the same name at the top; the
    cels lie partly outside of the canvas. The inner group is hidden in every third file."""
    hexes = lambda *fields: F.concat(*[L._little(v, n) for v, n in fields])
    half = lambda c: F.octet_length(F.unhex(c))
    chunk = lambda kind, body: F.concat(hexes((half(body) + 6, 4), (kind, 2)), body)
    i = F.col("image_id")
    layer = lambda name, flags, sort, level: chunk(sprites.LAYER, F.concat(hexes((flags, 2), (sort, 2), (level, 2), (0, 4), (0, 2), (255, 1), (0, 3)), hexes((len(name), 2)), F.lit(name.encode().hex())))
    tree = [layer("Body", 1, 1, 0), layer("Arm", F.when(i % 3 == 0, 0).otherwise(1), 1, 1), layer("ink", 1, 0, 2), layer("shade", 1, 0, 1), layer("ink", 1, 0, 0)]
    cel = lambda at, x, y: chunk(sprites.CEL, F.concat(hexes((at, 2), (x, 2), (y, 2), (255, 1), (0, 2), (0, 7), (F.col("width"), 2), (F.col("height"), 2)), F.hex("data")))
    body = F.concat(*tree, cel(2, F.pmod(i, F.lit(9)) - 4, F.pmod(i, F.lit(3)) - 1), cel(4, F.lit(0), F.lit(0)))
    frame = F.concat(hexes((half(body) + 16, 4), (sprites.FRAME_MAGIC, 2), (7, 2), (100, 2), (0, 2), (7, 4)), body)
    head = hexes((half(frame) + 128, 4), (sprites.MAGIC, 2), (1, 2), (F.col("width"), 2), (F.col("height"), 2), (32, 2))
    return L.pack(X.rgba(spark, d)).select(i.cast("string").alias("path"), F.unhex(F.concat(head, F.lit("00" * (128 - 14)), frame)).alias("content"))


#: Names that are looked up; the last three find no image layer.
_WANTED = ("body/arm/ink", "ARM\\INK", "ink", "body/shade", "body/ink", "Body", "nowhere")


def _layer_images(spark, d):
    files = _layered(spark, d)
    wanted = files.select("path", F.explode(F.array(*map(F.lit, _WANTED))).alias("wanted"))
    return sprites.layer_images(files, wanted).withColumn("image_id", F.col("path").cast("long")).drop("path")


QUERIES["b30_layer_images"] = _layer_images
ORACLE_SQL["b30_layer_images"] = f"""WITH {X.RGBA_SQL}, w AS (SELECT unnest(['body/arm/ink', 'ARM\\INK', 'ink']) AS wanted)
SELECT c.image_id, w.wanted, c.width, c.height, c.x, c.y, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, coalesce(p.a, 0) AS a
FROM px AS c, w LEFT JOIN px AS p ON p.image_id = c.image_id AND p.x = c.x - (c.image_id % 9 - 4) AND p.y = c.y - (c.image_id % 3 - 1)"""
QUERIES["b32_layer_paths"] = lambda spark, d: sprites.layer_paths(sprites.layers(_layered(spark, d))).select(F.col("path").cast("long").alias("image_id"), "layer_index", "name", "is_group", "full_path", "depth", "shown")
ORACLE_SQL["b32_layer_paths"] = """WITH l(layer_index, name, is_group, full_path, depth) AS (VALUES (0, 'Body', true, 'Body', 0), (1, 'Arm', true, 'Body/Arm', 1), (2, 'ink', false, 'Body/Arm/ink', 2), (3, 'shade', false, 'Body/shade', 1), (4, 'ink', false, 'ink', 0))
SELECT vec_id AS image_id, l.*, NOT (layer_index IN (1, 2) AND vec_id % 3 = 0) AS shown FROM embeddings, l"""


def _moving(spark, d):
    """Four images at a time as the frames of an animation: parts transparent, offsets and disposals of all kinds, a comment."""
    i = F.col("image_id")
    one = Q.expand(X.gray(spark, d).withColumn("v", F.floor(F.col("v") / 16).cast("int")), palettes()["ega64"])
    clear = F.pmod(F.col("x") * 3 + F.col("y") + i, F.lit(5)) < 2
    one = one.withColumns({c: F.when(clear, 0).otherwise(F.col(c)) for c in "rgba"})
    frames = one.withColumns({
        "frame_no": F.pmod(i, F.lit(4)).cast("int"), "delay": (5 + i % 7).cast("int"), "left": (i % 3).cast("int"), "top": (i * 2 % 5).cast("int"),
        "disposal": (F.floor(i / 3) % 4).cast("int"), "comment": F.concat(F.lit("für "), F.floor(i / 4).cast("string")),
    })
    return L.save_frames(frames.withColumn("image_id", F.floor(i / 4).cast("long")), repeat=3).select(F.col("image_id").cast("string").alias("path"), "content")


QUERIES["b22_animation_fields"] = lambda spark, d: L.decode_frames(_moving(spark, d)).drop("data").withColumn("image_id", F.col("path").cast("long")).drop("path")
_FRAMES_SQL = f"""fr AS (SELECT vec_id AS id, vec_id // 4 AS image_id, CAST(vec_id % 4 AS INT) AS frame_no, CAST(5 + vec_id % 7 AS INT) AS delay, CAST(vec_id % 3 AS INT) AS "left", CAST(vec_id * 2 % 5 AS INT) AS top, CAST(vec_id // 3 % 4 AS INT) AS disposal FROM embeddings),
an AS (SELECT image_id, CAST(max("left") + 8 AS INT) AS canvas_width, CAST(max(top) + 8 AS INT) AS canvas_height, count(*) AS n FROM fr GROUP BY image_id)"""
ORACLE_SQL["b22_animation_fields"] = f"""WITH {_FRAMES_SQL}
SELECT image_id, canvas_width, canvas_height, CASE WHEN n > 1 THEN 3 END AS repeat, 'für ' || image_id AS comment, frame_no, "left", top, delay, disposal, false AS wait_key, true AS own_palette, 8 AS width, 8 AS height, NULL AS error
FROM fr JOIN an USING (image_id)"""
QUERIES["b22_animation_playback"] = lambda spark, d: L.play(L.decode_frames(_moving(spark, d))).withColumn("image_id", F.col("path").cast("long")).drop("path")
#: What stays is found by going back from each frame to the last one that painted or cleared the place for good.
ORACLE_SQL["b22_animation_playback"] = f"""WITH {X.GRAY_SQL}, pal(i, r, g, b) AS (VALUES {_EGA}), {_FRAMES_SQL},
paint AS (SELECT f.image_id, frame_no, disposal, gy.x + "left" AS x, gy.y + top AS y, r, g, b FROM gy JOIN fr AS f ON f.id = gy.image_id JOIN pal ON i = v // 16 WHERE (gy.x * 3 + gy.y + gy.image_id) % 5 >= 2),
lasting AS (
  SELECT image_id, frame_no, x, y, r, g, b, 255 AS a FROM paint WHERE disposal < 2
  UNION ALL SELECT f.image_id, frame_no, gy.x + "left", gy.y + top, 0, 0, 0, 0 FROM gy JOIN fr AS f ON f.id = gy.image_id WHERE disposal = 2),
cells AS (SELECT *, unnest(range(0, canvas_height)) AS y FROM (SELECT fr.image_id, frame_no, delay, canvas_width, canvas_height, unnest(range(0, canvas_width)) AS x FROM fr JOIN an USING (image_id))),
old AS (SELECT c.image_id, c.frame_no, c.x, c.y, arg_max(l.r, l.frame_no) AS r, arg_max(l.g, l.frame_no) AS g, arg_max(l.b, l.frame_no) AS b, arg_max(l.a, l.frame_no) AS a
  FROM cells AS c JOIN lasting AS l ON l.image_id = c.image_id AND l.x = c.x AND l.y = c.y AND l.frame_no < c.frame_no GROUP BY ALL)
SELECT c.image_id, c.frame_no, c.delay, c.canvas_width AS width, c.canvas_height AS height, CAST(c.x AS INT) AS x, CAST(c.y AS INT) AS y,
  coalesce(p.r, o.r, 0) AS r, coalesce(p.g, o.g, 0) AS g, coalesce(p.b, o.b, 0) AS b, CASE WHEN p.r IS NULL THEN coalesce(o.a, 0) ELSE 255 END AS a
FROM cells AS c LEFT JOIN paint AS p ON p.image_id = c.image_id AND p.frame_no = c.frame_no AND p.x = c.x AND p.y = c.y
  LEFT JOIN old AS o ON o.image_id = c.image_id AND o.frame_no = c.frame_no AND o.x = c.x AND o.y = c.y"""


QUERIES["b15_png_in_bands"] = lambda spark, d: L.load(L.save_png(X.canvas(spark, d), band=16).select(F.col("image_id").cast("string").alias("path"), "content"), "png").select("width", "height", "x", "y", "r", "g", "b", "a")
ORACLE_SQL["b15_png_in_bands"] = f"WITH {X.CANVAS_SQL} SELECT width, height, x, y, r, g, b, a FROM cv"

"""Properties that need no oracle: round trips, identities and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave import streaming
from pixelweave.functions.named import named_colors, palettes
from pixelweave.operators import compose, draw, geometry, palette, point, resample, stencil
from pixelweave.sources import codecs, files, fixtures

KEY = ["image_id", "width", "height", "x", "y", "r", "g", "b", "a"]


@pytest.fixture(scope="module")
def px(spark, data):
    return fixtures.rgba(spark, data).where("image_id < 20").cache()


def equal(a, b):
    a, b = a.select(*KEY), b.select(*KEY)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name,op", {
    "flip_horz": lambda d: geometry.flip_horz(geometry.flip_horz(d)), "flip_vert": lambda d: geometry.flip_vert(geometry.flip_vert(d)),
    "turns": lambda d: geometry.rotate90(geometry.rotate90(geometry.rotate90(geometry.rotate90(d)))), "turn_back": lambda d: geometry.rotate90_ccw(geometry.rotate90(d)),
    "half_turns": lambda d: geometry.rotate180(geometry.rotate180(d)), "invert": lambda d: point.invert(point.invert(d)), "swap": lambda d: point.swap_channels(point.swap_channels(d, "b", "g", "r"), "b", "g", "r"),
    "pad_crop": lambda d: geometry.crop(geometry.pad(d, 2, 1, 3, 4), 2, 1, 8, 2), "resize_same": lambda d: geometry.resize(d, 8, 2), "resample_same": lambda d: resample.resample(d, (8, 2), (8, 2)),
    "mix_self": lambda d: compose.mix(d, d, 0.3), "neutral": lambda d: point.brightness_contrast(d, 0, 0), "no_strength": lambda d: stencil.sharpen(d, 0.0),
}.items())
def test_identities(px, name, op):
    assert equal(op(px), px)


def test_grayscale_is_idempotent(px):
    assert equal(point.grayscale(point.grayscale(px)), point.grayscale(px))


def test_blur_of_a_constant_is_constant(px):
    flat = point.fill(px, (10, 200, 30, 40))
    assert equal(stencil.gaussian_blur(flat, 2.0), flat)
    assert equal(stencil.box_blur(flat), flat)


@pytest.mark.parametrize("fmt", ["png", "bmp", "targa"])
def test_codec_round_trip(fmt):
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (codecs.LOADERS[fmt](codecs.SAVERS[fmt](image)) == image).all()


def test_png_without_alpha_and_gif_frames():
    image = np.random.default_rng(2).integers(0, 4, (9, 6, 4)).astype(np.uint8) * 80
    image[:, :, 3] = 255
    assert (codecs.decode_png(codecs.encode_png(image, alpha=False)) == image).all()
    gif = codecs.encode_gif([(image, 5), (image[::-1], 7)])
    frames = codecs.decode_gif_frames(gif)
    assert [f[3] for f in frames] == [5, 7] and (frames[1][0] == image[::-1]).all()
    big = np.zeros((80, 90, 4), np.uint8)
    big[:, :, :3] = np.random.default_rng(3).integers(0, 6, (80, 90, 3)) * 50
    big[:, :, 3] = 255
    assert (codecs.decode_gif(codecs.gif_of(big)) == big).all()


@pytest.mark.parametrize("fmt", ["bmp", "targa"])
def test_plain_files_are_written_by_expressions(spark, px, fmt):
    out = files.save(px, fmt)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    images = {r.image_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4) for r in files.pack(px).collect()}
    assert {r.image_id: bytes(r.content) for r in out.collect()} == {k: codecs.SAVERS[fmt](v) for k, v in images.items()}


def test_bmp_lines_from_the_top(spark):
    image = np.random.default_rng(4).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    data = bytearray(codecs.encode_bmp(image[::-1]))
    data[22:26] = (-3).to_bytes(4, "little", signed=True)
    assert (codecs.decode_bmp(bytes(data)) == image).all()
    row = files.metadata(spark.createDataFrame([("a", data)], "path string, content binary")).first()
    assert (row.format, row.width, row.height) == ("bmp", 5, 3)
    huge = bytearray(codecs.encode_png(image))
    huge[16:20] = b"\xff" * 4
    row = files.metadata(spark.createDataFrame([("a", huge)], "path string, content binary")).first()
    assert (row.format, row.width, row.height) == ("png", None, 3)


def test_broken_files_give_no_pixels(spark):
    rows = spark.createDataFrame([("a.png", bytearray(codecs.MAGIC)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert files.load(rows).count() == 0


def test_nearest_matches_brute_force(px):
    table = palettes()["nes54"]
    for r in palette.to_palette(px, table).join(px, ["image_id", "x", "y"]).limit(60).collect():
        d = [sum((p - v) ** 2 for p, v in zip(c, (r.r, r.g, r.b), strict=True)) for c in table]
        assert r.v == d.index(min(d))


@pytest.mark.parametrize("name", sorted(palette.DIFFUSION))
def test_diffusion_in_fronts_equals_raster_order(name):
    divisor, taps = palette.DIFFUSION[name]
    image = np.random.default_rng(4).integers(0, 256, (11, 9, 3))
    table = np.array(palettes()["cga16"])
    work, out = image.astype(int).copy(), np.zeros((11, 9), int)
    for y in range(11):
        for x in range(9):
            out[y, x] = ((work[y, x] - table) ** 2).sum(axis=1).argmin()
            e = work[y, x] - table[out[y, x]]
            for dx, dy, k in taps:
                if 0 <= x + dx < 9 and y + dy < 11:
                    share = e * k // divisor if divisor in (8, 16, 32) else np.trunc(e * k / divisor).astype(int)
                    work[y + dy, x + dx] = np.clip(work[y + dy, x + dx] + share, 0, 255)
    assert (palette.diffuse(np.stack([image, image[::-1]]), table, name)[0] == out).all()


def test_median_cut(px):
    colors = np.random.default_rng(5).integers(0, 256, (300, 3))
    found = palette.median_cut(colors, np.ones(300, int), 16)
    assert len(found) == 16
    assert palette.median_cut(colors[:5], np.ones(5, int), 16) == sorted(map(tuple, colors[:5].tolist()))
    assert palette.quantize(px, 4).groupBy("image_id").count().agg(F.max("count")).first()[0] <= 4


def test_line_is_connected_and_clipped(spark, data):
    canvas = fixtures.canvas(spark, data)
    hit = draw.draw_line(point.fill(canvas, (0, 0, 0, 255)), (-5, -3), (30, 60), (1, 2, 3, 255)).where("r = 1").orderBy("y").collect()
    assert all(abs(a.x - b.x) <= 1 and b.y - a.y == 1 for a, b in zip(hit, hit[1:], strict=False)) and hit


def test_named_tables():
    assert len(named_colors()) == 148 and palettes()["grayscale8a"][-1] == (255, 255, 255) and len(palettes()["web216"]) == 216


def test_empty_table(spark, data):
    empty = fixtures.rgba(spark, data).where("false")
    assert point.grayscale(empty).count() == 0 and geometry.pad(empty, 1, 1, 1, 1).count() == 0 and stencil.box_blur(empty).count() == 0


def test_stream_counts_all_pixels(spark, tmp_path):
    image = np.full((3, 4, 4), 255, np.uint8)
    (tmp_path / "a.png").write_bytes(codecs.encode_png(image))
    (tmp_path / "b.bmp").write_bytes(codecs.encode_bmp(image))
    q = streaming.histograms(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM hist").collect()] == [(255, 255, 255, 24)]
    finally:
        q.stop()


def sprite():
    """Two frames of one 2 x 1 layer, the second a link, with a tag."""
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack("<IH", 6 + len(body), kind) + body

    name = b"ink"
    layer = chunk(0x2004, struct.pack("<6HB3x", 1, 0, 0, 0, 0, 0, 255) + struct.pack("<H", len(name)) + name)
    cel = chunk(0x2005, struct.pack("<HhhBH7x", 0, 1, -1, 200, 2) + struct.pack("<2H", 2, 1) + zlib.compress(bytes([1, 2, 3, 4, 5, 6, 7, 8])))
    link = chunk(0x2005, struct.pack("<HhhBH7x", 0, 0, 0, 255, 1) + struct.pack("<H", 0))
    tag = chunk(0x2018, struct.pack("<H8x", 1) + struct.pack("<HHB12x", 0, 1, 2) + struct.pack("<H", 3) + b"run")
    frames = b""
    for chunks, ms in (([layer, tag, cel], 100), ([link], 50)):
        body = b"".join(chunks)
        frames += struct.pack("<IHHHHI", 16 + len(body), 0xF1FA, len(chunks), ms, 0, len(chunks)) + body
    head = struct.pack("<IHHHHH", 128 + len(frames), 0xA5E0, 2, 4, 4, 32)
    return head + bytes(128 - len(head)) + frames


def test_sprites(spark):
    from pixelweave.sources import sprites

    rows = spark.createDataFrame([("a.ase", bytearray(sprite())), ("b.ase", bytearray(b"no sprite"))], "path string, content binary")
    found = sprites.cels(rows).orderBy("frame_no").collect()
    assert [(r.frame_no, r.duration_ms, r.layer_name, r.cel_x, r.cel_y, r.opacity) for r in found] == [(0, 100, "ink", 1, -1, 200), (1, 50, "ink", 0, 0, 255)]
    assert bytes(found[1].data) == bytes(range(1, 9))
    assert [tuple(r)[1:] for r in sprites.tags(rows).collect()] == [("run", 0, 1, 2)]
    assert files.unpack(sprites.cels(rows)).count() == 4


def test_jvm_reader(spark, tmp_path):
    image = np.random.default_rng(6).integers(0, 256, (4, 6, 4)).astype(np.uint8)
    image[:, :, 3] = 255
    (tmp_path / "a.png").write_bytes(codecs.encode_png(image, alpha=False))
    for r in files.read_with_jvm(spark, str(tmp_path)).collect():
        assert (r.r, r.g, r.b, r.a) == tuple(image[r.y, r.x].tolist())


def test_jpeg(spark, tmp_path):
    """Written in bands, read by Spark's image source: near the original, equal to the whole image coded in one go."""
    from pixelweave.sources import jpeg

    at = np.mgrid[0:21, 0:37]
    smooth = np.dstack([at[1] * 6, at[0] * 12, (at[0] + at[1]) * 4, at[0] * 0 + 255]).astype(np.uint8)
    noise = np.random.default_rng(3).integers(0, 256, (9, 16, 4)).astype(np.uint8)
    plain = np.full((80, 3, 4), 255, np.uint8)
    rows = [(k, i.shape[1], i.shape[0], bytearray(i.tobytes())) for k, i in enumerate((smooth, noise, plain))]
    pixels = files.unpack(spark.createDataFrame(rows, "image_id long, width int, height int, data binary"))
    for k, (quality, most, mean) in enumerate(((85, 40, 3), (100, 6, 1.5), (85, 2, 1))):
        image = (smooth, noise, plain)[k]
        content = bytes(files.save_jpeg(pixels.where(f"image_id = {k}"), quality=quality).first().content)
        assert content == jpeg.encode(image, quality)
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.jpg").write_bytes(content)
        found = files.read_with_jvm(spark, str(tmp_path / str(k))).toPandas()
        assert len(found) == image.shape[0] * image.shape[1]
        off = np.abs(found[["r", "g", "b"]].to_numpy().astype(int) - image[found.y, found.x, :3].astype(int))
        assert off.max() <= most and off.mean() <= mean
    sniffed = files.metadata(files.save(pixels, "jpeg").select(F.col("image_id").cast("string").alias("path"), "content"))
    assert {(r.format, r.width, r.height) for r in sniffed.collect()} == {("jpeg", 37, 21), ("jpeg", 16, 9), ("jpeg", 3, 80)}
    cut = spark.createDataFrame([("a.jpg", bytearray(jpeg.encode(noise)[:80]))], "path string, content binary")
    assert [tuple(r) for r in files.metadata(cut).collect()] == [("a.jpg", "jpeg", None, None)]
    wide = spark.createDataFrame([(1, 70_000, 1, 0, 0, 1, 2, 3, 4)], "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")
    assert files.save_jpeg(wide).first().content is None


def test_png_notes(spark):
    """Compressed notes, colour chunks, broken ones, repeated keys; pixels stay as they are."""
    import struct
    import zlib

    image = np.random.default_rng(4).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    file = codecs.encode_png(image)
    extra = [
        (b"cHRM", struct.pack(">8I", *range(10_000, 90_000, 10_000))), (b"sRGB", b"\1"), (b"iCCP", b"mine\0\0" + zlib.compress(b"profile")),
        (b"zTXt", b"author\0\0" + zlib.compress("é".encode("latin-1"))), (b"iTXt", b"Note\0\1\0de\0\0" + zlib.compress("→".encode())),
        (b"tEXt", b"Title\0one"), (b"tEXt", b"title\0two"), (b"zTXt", b"broken\0\0xx"), (b"iTXt", b"short"),
    ]
    noted = file[:33] + b"".join(codecs._chunk(*c) for c in extra) + file[33:]
    rows = spark.createDataFrame([("a", bytearray(noted)), ("b", bytearray(b"none")), ("c", None), ("d", bytearray(file))], "path string, content binary")
    found = {r.key: r.value for r in files.png_metadata(rows).collect()}
    names = ("WhitePointX", "WhitePointY", "RedX", "RedY", "GreenX", "GreenY", "BlueX", "BlueY")
    colours = {f"Chromaticity{n}": str((i + 1) / 10) for i, n in enumerate(names)}
    assert found == colours | {"SrgbRenderingIntent": "RelativeColorimetric", "IccpProfile": "cHJvZmlsZQ==", "IccpProfileName": "mine", "Author": "é", ".Note": "→", "Title": "two"}
    given = rows.where("path = 'd'").withColumn("metadata", F.expr("map('Title', 'x', '.k', null, 'Gamma', 'none', 'unknown', 'y', 'PixelsPerMeterX', '3')"))
    written = files.with_png_metadata(given)
    assert {r.key: r.value for r in files.png_metadata(written).collect()} == {"Title": "x", ".k": ""}
    assert (codecs.decode_png(bytes(written.first().content)) == image).all()
    same = files.with_png_metadata(rows.withColumn("metadata", F.expr("cast(null as map<string, string>)")))
    assert {r.path: r.content for r in same.collect()} == {r.path: r.content for r in rows.collect()}


def test_convolutions_do_not_see_pieces(px, monkeypatch):
    kernel = [1, 2, 3, 4, 5, 6, 7]
    runs = [lambda: stencil.convolve(px, range(1, 16), 5, 3, 0.7, True), lambda: stencil.convolve_line(px, kernel, "x", 1.0, True), lambda: stencil.convolve_line(px, kernel, "y", 1.0, True), lambda: stencil.gaussian_blur(px, 2.0)]
    whole = [run() for run in runs]
    for size in (1, 2, 3):
        monkeypatch.setattr(stencil, "PIECE", size)
        for run, expected in zip(runs, whole, strict=True):
            assert equal(run(), expected)


def test_unreadable_files_are_told(spark):
    good = codecs.encode_png(np.zeros((1, 2, 4), np.uint8))
    rows = [("good", bytearray(good)), ("cut", bytearray(good[:50])), ("text", bytearray(b"no image")), ("null", None), ("sprite.jpg", bytearray(b"\xff\xd8\xff\xe0"))]
    found = {r.path: r for r in files.decode(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p: r.error for p, r in found.items() if p != "cut"} == {"good": None, "text": "unknown format", "null": "no content", "sprite.jpg": "no loader for jpeg"}
    assert found["cut"].error and found["cut"].data is None and (found["good"].width, found["good"].height, bytes(found["good"].data)) == (2, 1, bytes(8))

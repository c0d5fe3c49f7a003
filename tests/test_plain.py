"""BMP and Targa files of all kinds: column expressions against the array decoder."""

import struct

import numpy as np
import pytest

from pixelweave.sources import codecs, files, plain

RNG = np.random.default_rng(5)


def bmp(w, h, depth, masks=None, size=40, down=False, used=0, pad=0, seed=0):
    rng = np.random.default_rng(seed)
    row = -(-w * depth // 32) * 4
    n = used or (1 << depth if depth <= 8 else 0)
    extra = b"" if masks is None else struct.pack(f"<{len(masks)}I", *masks)
    palette = rng.integers(0, 256, 4 * n, dtype=np.uint8).tobytes()
    body = rng.integers(0, 256 if not used else 1, (h, row), dtype=np.uint8).tobytes()
    head = struct.pack("<IiiHHIIiiII", size, w, -h if down else h, 1, depth, 3 if masks else 0, 0, 0, 0, used, 0) + extra
    head = head.ljust(size, b"\0") if size > 40 else head
    at = 14 + len(head) + len(palette) + pad
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + head + palette + b"\0" * pad + body


def targa(w, h, kind, depth, bits=0, first=0, count=0, flags=0, note=b"", seed=0):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 256, count * -(-bits // 8), dtype=np.uint8).tobytes()
    wide = -(-depth // 8)
    body = rng.integers(0, 256, w * h * wide, dtype=np.uint8).tobytes()
    if kind == 1:
        index = rng.integers(first, first + count, w * h)
        body = (index.astype(np.uint8) if depth == 8 else index.astype("<u2")).tobytes()
    return struct.pack("<BBBHHBHHHHBB", len(note), int(kind == 1), kind, first, count, bits, 0, 0, w, h, depth, flags) + note + palette + body


BMPS = {
    **{f"{d} bits": bmp(w, 5, d, seed=d) for d, w in ((1, 19), (4, 7), (8, 6), (16, 5), (24, 7), (32, 3))}, "from the top": bmp(5, 4, 24, down=True), "one bit, from the top": bmp(33, 3, 1, down=True), "few colours": bmp(9, 2, 8, used=3),
    "565": bmp(6, 3, 16, (0xF800, 0x7E0, 0x1F)), "4444 with alpha": bmp(6, 3, 16, (0xF00, 0xF0, 0xF, 0xF000), 56), "fields of 32": bmp(6, 3, 32, (0xFF, 0xFF00, 0xFF0000, 0xFF000000), 108), "ten bits": bmp(6, 3, 32, (0x3FF00000, 0xFFC00, 0x3FF)), "a gap": bmp(4, 4, 24, pad=7),
    "one pixel": bmp(1, 1, 32), "written": codecs.encode_bmp(RNG.integers(0, 256, (4, 6, 4), dtype=np.uint8)),
}
TARGAS = {
    **{f"{d} bits": targa(5, 4, 2, d, seed=d) for d in (15, 16, 24, 32)}, "gray": targa(7, 3, 3, 8), "map of 24": targa(5, 4, 1, 8, 24, 0, 200), "map of 32": targa(5, 4, 1, 8, 32, 10, 50), "map of 16": targa(5, 4, 1, 8, 16, 0, 256), "wide index": targa(5, 4, 1, 16, 24, 300, 900),
    **{f"origin {f}": targa(5, 4, 2, 24, flags=f, seed=f) for f in (0, 16, 32, 48)}, "note": targa(3, 3, 2, 32, note=b"a note"), "written": codecs.encode_targa(RNG.integers(0, 256, (4, 6, 4), dtype=np.uint8)),
}


@pytest.mark.parametrize("given,load,decode", [(BMPS, plain.load_bmp, codecs.decode_bmp), (TARGAS, plain.load_targa, codecs.decode_targa)])
def test_expressions_equal_the_decoder(spark, given, load, decode):
    rows = spark.createDataFrame(list(given.items()), "path string, content binary")
    found = {}
    for r in load(rows).collect():
        found.setdefault(r.path, np.full((r.height, r.width, 4), -1))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    for name, data in given.items():
        want = decode(data)
        assert want is not None and found[name].shape == want.shape and (found[name] == want).all(), name
    assert found.keys() == given.keys()
    assert not [s for s in load(rows)._jdf.queryExecution().executedPlan().toString().splitlines() if "Python" in s or "Arrow" in s]


def test_errors_are_told_and_give_no_pixels(spark):
    good = bmp(4, 4, 24)
    packed = bytearray(good)
    packed[30] = 1
    rows = spark.createDataFrame([("null", None), ("empty", b""), ("text", b"some text, long enough to hold a header of some kind, though it is none at all"), ("cut", good[:-1]), ("coded", bytes(packed)), ("good", good)], "path string, content binary")
    told = {r.path: r.error for r in plain.bmp_headers(rows).collect()}
    assert told.pop("good") is None and all(told.values()) and told["coded"] == "unsupported variant" and "early" in told["cut"]
    assert {r.path for r in plain.load_bmp(rows).collect()} == {"good"} == {r.path for r in files.load(rows, "bmp").collect()}
    tga = targa(4, 4, 2, 24)
    rows = spark.createDataFrame([("null", None), ("empty", b""), ("cut", tga[:-1]), ("coded", tga[:2] + b"\x0a" + tga[3:]), ("good", tga)], "path string, content binary")
    told = {r.path: r.error for r in plain.targa_headers(rows).collect()}
    assert told.pop("good") is None and all(told.values())
    assert {r.path for r in plain.load_targa(rows).collect()} == {"good"}


@pytest.mark.parametrize("alpha,band", [(True, 1), (True, 4), (False, 5), (True, 64)])
def test_png_in_bands(spark, alpha, band):
    """Bands of any height make a file that the decoder, the whole coder and Spark's own image reader agree on."""
    images = {f"i{k}": np.random.default_rng(k).integers(0, 256 if k % 2 else 3, (h, w, 4), dtype=np.uint8) for k, (w, h) in enumerate(((1, 1), (7, 4), (3, 20), (300, 65), (5, 128)))}
    rows = [(k, px.shape[1], px.shape[0], x, y, *map(int, px[y, x])) for k, px in images.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")
    saved = {r.image_id: bytes(r.content) for r in files.save_png(df, alpha=alpha, band=band).collect()}
    assert saved.keys() == images.keys()
    for k, px in images.items():
        want = px.copy()
        if not alpha:
            want[:, :, 3] = 255
        assert (codecs.decode_png(saved[k]) == want).all()
        if band >= px.shape[0]:
            assert len(saved[k]) <= len(codecs.encode_png(px, alpha)) + 40
    assert files.save_png(df.where("false")).count() == 0


def test_banded_png_opens_in_the_jvm(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (90, 31, 4), dtype=np.uint8)
    px[:, :, 3] = 255
    rows = [("a", 31, 90, x, y, *map(int, px[y, x])) for y in range(90) for x in range(31)]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")
    (tmp_path / "a.png").write_bytes(files.save_png(df, alpha=False, band=7).first().content)
    back = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in files.read_with_jvm(spark, str(tmp_path)).collect()}
    assert back == {(x, y): tuple(map(int, px[y, x])) for y in range(90) for x in range(31)}

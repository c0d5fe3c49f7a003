"""Image files as a source and sink, animations, layer trees and images of mixed sizes on edge cases."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions.lineage import scratch
from pixelweave.operators import geometry, resample
from pixelweave.sources import codecs, files, imagefiles, sprites


def image(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def jpeg_with(segments, size=60, tail=b""):
    frame = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 21, 34) + b"\x03" + b"\0" * 9
    return b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", size + 2) + b"x" * size) * segments + tail + frame + b"\xff\xd9" + b"\0" * 100


# ------------------------------------------------------------------ files


@pytest.fixture(scope="module")
def folder(spark):
    rows = [("a.png", codecs.encode_png(image(30, 40))), ("deep/er/b.bmp", codecs.encode_bmp(image(300, 400))), ("deep/c.tga", codecs.encode_targa(image(3, 2))), ("d.gif", codecs.gif_of(np.zeros((5, 7, 4), np.uint8)))]
    rows += [("e.jpg", jpeg_with(0)), ("f.jpg", jpeg_with(2000)), ("g.jpg", jpeg_with(9, 60_000)), ("h.jpg", b"\xff\xd8\xff\xe0\x00\x04"), ("i.txt", b"plain text"), ("j.png", b""), ("k.png", None), ("l.jpg", jpeg_with(1, tail=b"\xff\xff\xff\xff"))]
    path = scratch(spark, "test-images")
    imagefiles.write(spark.createDataFrame(rows, "path string, content binary"), path)
    return path.removeprefix("file:"), dict(rows)


def test_heads_tell_sizes(spark, folder):
    path, rows = folder
    found = {os.path.basename(r.path): (r.format, r.width, r.height, r.color, r.bits) for r in files.head_metadata(spark, path).collect()}
    assert found == {
        "a.png": ("png", 30, 40, "rgba", 32), "b.bmp": ("bmp", 300, 400, "rgba", 32), "c.tga": ("targa", 3, 2, "rgba", 32), "d.gif": ("gif", 7, 5, "palette", 2 + found["d.gif"][4] - 2),
        "e.jpg": ("jpeg", 34, 21, "rgb", 24), "f.jpg": ("jpeg", 34, 21, "rgb", 24), "g.jpg": ("jpeg", 34, 21, "rgb", 24), "l.jpg": ("jpeg", 34, 21, "rgb", 24),
        "h.jpg": ("jpeg", None, None, None, None), "i.txt": (None, None, None, None, None), "j.png": (None, None, None, None, None),
    }
    whole = spark.createDataFrame([(k, v) for k, v in rows.items() if v is not None], "path string, content binary")
    assert {r.path.split("/")[-1]: (r.format, r.width, r.height) for r in files.metadata(whole).collect()} == {k: v[:3] for k, v in found.items()}


def test_only_ranges_are_read(spark, folder):
    path, rows = folder
    read = {os.path.basename(r.path): (r.length, r.bytes_read, r.frame) for r in imagefiles.read(spark, path, ("path", "length", "bytes_read", "frame")).collect()}
    assert read["b.bmp"][0] > 400_000 and read["b.bmp"][1] == 16_384
    assert all(n <= 16_384 for k, (_, n, _) in read.items() if k not in ("f.jpg", "g.jpg"))
    assert read["f.jpg"][1] <= len(rows["f.jpg"]) + 4_096 and read["g.jpg"][1] < 16_384 + 12 * 4_096 < len(rows["g.jpg"]) / 5
    names = imagefiles.read(spark, path, ("path", "length"))
    assert names.columns == ["path", "length"] and {r.length for r in names.collect()} == {len(v) for v in rows.values() if v is not None}
    sniffed = imagefiles.read(spark, path, ("path", "bytes_read", "head"), head=imagefiles.SNIFF).collect()
    assert all(len(r.head) <= 4_096 == imagefiles.SNIFF and r.bytes_read <= 4_096 for r in sniffed)
    with pytest.raises(Exception, match="columns are of"):
        imagefiles.read(spark, path).select("path").sparkSession.read.format(imagefiles.FORMAT).schema("nothing int").load(path).count()


def test_filters_choose_files_before_they_are_opened(spark, folder):
    path, rows = folder
    all_ = imagefiles.read(spark, path, ("path", "length", "content"))
    png = all_.where(F.col("path").endswith(".png") & (F.col("length") > 0))
    assert [r.content for r in png.collect()] == [rows["a.png"]]
    reader = imagefiles.Reader(all_.schema, {"path": path})
    from pyspark.sql import datasource as ds

    left = list(reader.pushFilters([ds.StringEndsWith(("path",), ".jpg"), ds.GreaterThan(("length",), 1000), ds.EqualTo(("content",), b"")]))
    assert len(left) == 1 and sorted(os.path.basename(n) for g in reader.partitions() for n, _ in g.files) == ["f.jpg", "g.jpg"]
    assert all_.where(F.col("path").contains("deep")).count() == 2 and all_.where("length IS NULL").count() == 0


def test_files_go_out_and_in(spark, folder):
    path, rows = folder
    one = imagefiles.read(spark, f"{path}/a.png", ("path", "content")).collect()
    assert [r.content for r in one] == [rows["a.png"]]
    assert not [n for _, _, names in os.walk(path) for n in names if n.startswith(".") and not n.endswith(".crc")]
    again = spark.createDataFrame([("x/y.bin", b"1")], "path string, content binary")
    imagefiles.write(again, path + "-two")
    imagefiles.write(again.withColumn("content", F.lit("22").cast("binary")), path + "-two")
    assert [r.content for r in imagefiles.read(spark, path + "-two", ("content",)).collect()] == [b"22"]
    imagefiles.write(spark.createDataFrame([("z", b"3")], "path string, content binary"), path + "-two", "overwrite")
    assert [os.path.basename(r.path) for r in imagefiles.read(spark, path + "-two", ("path",)).collect()] == ["z"]
    for bad in ("../out", "/root", "a//b", ""):
        with pytest.raises(Exception, match="no relative path"):
            imagefiles.write(spark.createDataFrame([(bad, b"1")], "path string, content binary"), path + "-two")


def test_a_file_that_goes_is_told(spark, folder, tmp_path):
    gone = imagefiles.Reader(imagefiles.read(spark, folder[0]).schema, {"path": str(tmp_path)})
    rows = next(gone.read(imagefiles.Group([(f"{tmp_path}/none", 7)]))).to_pylist()
    assert rows == [{"path": f"{tmp_path}/none", "length": 7, "head": None, "frame": None}]


def test_damaged_png_is_told(spark):
    good = codecs.encode_png(image(9, 9))
    bad = bytearray(good)
    bad[60] ^= 1
    rows = spark.createDataFrame([("good", good), ("bad", bytes(bad)), ("short", good[:-20])], "path string, content binary")
    found = {r.path: r.error for r in files.decode(rows, "png").collect()}
    assert found["good"] is None and "damaged" in found["bad"] and found["short"]


# ------------------------------------------------------------------ animations


def played(a):
    canvas, out = np.zeros((a.height, a.width, 4), np.uint8), []
    for px, x, y, _, disposal, _, _ in a.frames:
        shown = canvas.copy()
        h, w = max(0, min(px.shape[0], a.height - y)), max(0, min(px.shape[1], a.width - x))
        part = px[:h, :w]
        shown[y : y + h, x : x + w][part[:, :, 3] > 0] = part[part[:, :, 3] > 0]
        out.append(shown)
        if disposal != 3:
            canvas = shown.copy()
        if disposal == 2:
            canvas[y : y + h, x : x + w] = 0
    return out


def test_play_equals_a_plain_player(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        frames = []
        for _ in range(int(rng.integers(1, 7))):
            px = np.zeros((*rng.integers(1, 6, 2), 4), np.uint8)
            on = rng.random(px.shape[:2]) < 0.5
            px[on] = np.append(rng.integers(0, 256, 3), 255)
            frames.append((px, int(rng.integers(0, 9)), *map(int, rng.integers(0, 4, 2)), int(rng.integers(0, 4))))
        rows.append((str(k), codecs.encode_gif(frames, 5, "hé")))
    cut = bytearray(rows[0][1])
    cut[6:10] = struct.pack("<HH", 2, 2)  # a canvas that its frames reach out of
    rows.append(("cut", bytes(cut)))
    table = spark.createDataFrame([*rows, ("no", b"GIF89a"), ("null", None)], "path string, content binary")
    told = files.decode_frames(table)
    assert {r.path for r in told.where("error IS NOT NULL").collect()} == {"no", "null"}
    got = {}
    for r in files.play(told).collect():
        got.setdefault((r.path, r.frame_no), np.full((r.height, r.width, 4), 7, np.uint8))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    want = {(p, k): s for p, c in rows for k, s in enumerate(played(codecs.gif_animation(c)))}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert codecs.gif_animation(rows[0][1]).comment == "hé"


# ------------------------------------------------------------------ layers


def test_layer_paths_of_deep_trees(spark):
    rows = [("deep", i, f"n{i}", i != 20, i - 1 if i else None) for i in range(70)] + [("a", 0, "top", True, None), ("a", 1, None, True, 0), ("a", 2, "orphan", True, 9), ("a", 3, "x", True, 4), ("a", 4, "y", True, 3), ("a", 5, "z", None, None)]
    tree = spark.createDataFrame(rows, "path string, layer_index int, name string, visible boolean, parent_index int")
    found = {(r.path, r.layer_index): (r.full_path, r.depth, r.shown) for r in sprites.layer_paths(tree).collect()}
    assert len(found) == len(rows)
    assert all(found["deep", i] == ("/".join(f"n{k}" for k in range(i + 1)), i, i < 20) for i in range(70))
    assert [found["a", i] for i in range(6)] == [("top", 0, True), ("top/", 1, True), ("orphan", 0, True), (None, None, None), (None, None, None), ("z", 0, False)]
    assert sprites.layer_paths(tree.where("false")).count() == 0


def test_names_find_the_lowest_layer(spark):
    rows = [("f", 0, "G", True, None), ("f", 1, "a", False, 0), ("f", 2, "A", False, 0), ("f", 3, "g", True, 0), ("f", 4, "b", False, 3), ("f", 5, "a", False, None), ("e", 0, "a", True, None)]
    tree = spark.createDataFrame(rows, "path string, layer_index int, name string, is_group boolean, parent_index int")
    wanted = spark.createDataFrame([("f", w) for w in ("a", "g/A", "G\\g\\B", "g/g", "b", "a/b", "", "g/", None)] + [("e", "a"), (None, "a"), ("f", "a")], "path string, wanted string")
    assert {(r.path, r.wanted): r.layer_index for r in sprites.find_layers(tree, wanted).collect()} == {("f", "a"): 1, ("f", "g/A"): 1, ("f", "G\\g\\B"): 4, ("f", "b"): 4}
    assert sprites.find_layers(tree, wanted.where("false")).count() == 0


def test_broken_sprites_are_told(spark):
    rows = spark.createDataFrame([("a", b"nothing"), ("b", None), ("c", b"\0" * 4 + struct.pack("<H", sprites.MAGIC) + struct.pack("<4H", 3, 1, 1, 32) + b"\0" * 200)], "path string, content binary")
    told = {r.path: r.error for r in sprites.broken(rows).collect()}
    assert set(told) == {"a", "b"} and "no sprite file" in told["a"]
    assert sprites.cels(rows).count() == sprites.tags(rows).count() == sprites.layers(rows).count() == 0
    assert sprites.layer_images(rows, rows.select("path", F.lit("x").alias("wanted"))).count() == 0


# ------------------------------------------------------------------ mixed sizes


def rows_of(spark, images):
    rows = [(k, px.shape[1], px.shape[0], x, y, *map(int, px[y, x])) for k, px in images.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")


def plain_resample(px, new, mode, edges):
    left, top, right, bottom = edges
    for axis, size, to, low, high in ((1, px.shape[1], new[0], left, right), (0, px.shape[0], new[1], top, bottom)):
        px = np.moveaxis(px.astype(np.int64), axis, 0)
        out = np.zeros((to, *px.shape[1:]), np.int64)
        for d, s, w in resample.contributions(size, to, mode, low, high):
            out[d] += w * px[s]
        px = np.moveaxis(np.clip((out + 32_768) >> 16, 0, 255), 0, axis)
    return px


@pytest.mark.parametrize("mode,edges", [("bspline", ("back",) * 4), ("lanczos5", ("wrap", "back", "wrap", "wrap")), ("box", ("back",) * 4)])
def test_each_image_at_its_own_size(spark, mode, edges):
    rng = random.Random(4)
    images = {f"i{k}": image(rng.randint(1, 9), rng.randint(1, 9), k) for k in range(14)}
    sizes = {k: (rng.randint(1, 12), rng.randint(1, 12)) for k in images} | {"i0": (images["i0"].shape[1], images["i0"].shape[0]), "i1": (0, 5), "unknown": (3, 3)}
    del sizes["i2"]
    df, told = rows_of(spark, images), spark.createDataFrame([(k, *v) for k, v in sizes.items()] + [("i3x", None, 2)], "image_id string, new_width int, new_height int")
    want = {k: v for k, v in sizes.items() if k in images and v[0] > 0}
    nearest = {}
    for r in geometry.resize_each(df, told).collect():
        nearest.setdefault(r.image_id, np.full((r.height, r.width, 4), -1))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    got = {}
    for r in resample.resample_each(df, told, mode, edges).collect():
        got.setdefault(r.image_id, np.full((r.height, r.width, 4), -1))[r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert nearest.keys() == want.keys() == got.keys()
    for k, (w, h) in want.items():
        px = images[k]
        at = lambda n, size: [(i * (size * 65_536 // n)) >> 16 for i in range(n)]
        assert (nearest[k] == px[np.ix_(at(h, px.shape[0]), at(w, px.shape[1]))]).all()
        assert (got[k] == plain_resample(px, (w, h), mode, edges)).all()


def test_sizes_follow_the_plain_rules(spark):
    sizes = [(w, h) for w in (0, 1, 7, 100) for h in (0, 1, 9, 33)]
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "image_id long, width int, height int")
    for mode in geometry.FIT_MODES:
        assert {r.image_id: (r.new_width, r.new_height) for r in geometry.fitted_sizes(table, (20, 5), mode).collect()} == {i: geometry.fit(s, (20, 5), mode) for i, s in enumerate(sizes)}
    for w, h in ((None, None), (10, None), (None, 10), (3, 4)):
        assert {r.image_id: (r.new_width, r.new_height) for r in geometry.calculated_sizes(table, w, h).collect()} == {i: geometry.calculate_resize(s, w, h) for i, s in enumerate(sizes)}

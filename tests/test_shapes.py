"""Shapes painted from a relation against the same shapes drawn one after the other."""

import random

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import draw, shapes


def canvas(spark, sizes):
    rng = np.random.default_rng(2)
    rows = [(i, w, h, x, y, *map(int, rng.integers(0, 256, 4))) for i, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, x int, y int, r int, g int, b int, a int")


def table(df):
    return sorted(tuple(r) for r in df.select("image_id", "x", "y", "r", "g", "b", "a").collect())


def relation(spark, rows):
    return spark.createDataFrame(rows, shapes.SCHEMA)


def one_by_one(df, drawn):
    for kind, points, n, thickness, skip, mode, colors in drawn:
        c = colors[0]
        whole = [(int(x), int(y)) for x, y in points]
        if kind == "rect":
            df = draw.fill_rect(df, (*whole[0], *whole[1]), c, mode)
        elif kind == "frame":
            df = draw.draw_rect(df, (*whole[0], *whole[1]), c, thickness, mode)
        elif kind == "gradient":
            df = draw.fill_gradient_rect(df, (*whole[0], *whole[1]), *colors, mode)
        elif kind == "line":
            df = draw.draw_line(df, *whole, c, mode, skip)
        elif kind == "curve":
            df = draw.draw_bezier(df, *points, c, n, mode)
        else:
            df = draw.fill_polygon(df, points, c, mode)
    return df


def test_painting_equals_drawing_in_turn(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        drawn = []
        for kind in random.Random(seed).sample([*shapes.KINDS] * 2, 10):
            at = lambda low=-4, high=20: float(rng.randint(low, high))  # noqa: B023, E731
            points = {"line": 2, "curve": 4, "polygon": 5}.get(kind)
            points = [(at(), at()) for _ in range(points)] if points else [(at(-4, 9), at(-4, 9)), (at(1, 14), at(1, 14))]
            colors = [tuple(rng.choice([0, 60, 128, 200, 255]) for _ in range(4)) for _ in range(4 if kind == "gradient" else 1)]
            drawn.append((kind, points, rng.choice([0, 3, 9]), rng.randint(1, 3), rng.random() < 0.5, rng.choice(shapes.MODES), colors))
        df = canvas(spark, {0: (16, 13), 1: (3, 30)}).withColumn("extra", F.col("x") * 2)
        rows = [(i, k, *s) for i in (0, 1, 7) for k, s in enumerate(drawn)]
        random.Random(9).shuffle(rows)
        out = shapes.paint(df, relation(spark, rows))
        assert out.columns == df.columns
        assert table(out) == table(one_by_one(df, drawn).cache())


def test_shapes_without_sense_paint_nothing(spark):
    df = canvas(spark, {0: (4, 4)})
    ink = [(1, 2, 3, 255)]
    rows = [
        (0, 1, "blob", [(0.0, 0.0), (4.0, 4.0)], 0, 1, False, "copy", ink), (0, 2, None, [(0.0, 0.0)], 0, 1, False, "copy", ink), (0, 3, "rect", None, 0, 1, False, "copy", ink), (0, 4, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "copy", None),
        (9, 5, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "copy", ink), (None, 6, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "copy", ink), (0, 7, "rect", [(9.0, 9.0), (2.0, 2.0)], 0, 1, False, "copy", ink), (0, 8, "rect", [(0.0, 0.0), (0.0, -2.0)], 0, 1, False, "copy", ink),
        (0, 9, "polygon", [(0.0, 0.0), (3.0, 0.0)], 0, 1, False, "copy", ink),
    ]
    assert table(shapes.paint(df, relation(spark, rows))) == table(df) == table(shapes.paint(df, relation(spark, rows).where("false")))
    assert shapes.paint(df.where("false"), relation(spark, rows)).count() == 0


def test_far_shapes_are_clipped_before_they_are_written_out(spark):
    """A line and a rectangle of a thousand million pixels cost what their image holds."""
    big = 1_000_000_000.0
    ink = [(9, 9, 9, 255)]
    rows = [(0, 1, "line", [(-big, 5.0), (big, 5.0)], 0, 1, False, None, ink), (0, 2, "rect", [(8.0, 8.0), (big, big)], 0, 1, None, "alpha", ink)]
    out = table(shapes.paint(canvas(spark, {0: (10, 10)}), relation(spark, rows)))
    assert sorted((x, y) for _, x, y, *c in out if c == [9, 9, 9, 255]) == sorted([(x, 5) for x in range(10)] + [(x, y) for x in (8, 9) for y in (8, 9)])


def test_hidden_marks_are_not_gathered(spark):
    """Under an opaque shape nothing is kept, however many shapes lie there."""
    rows = [(0, k, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "alpha", [(k % 256, 0, 0, 100)]) for k in range(3000)] + [(0, 3000, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "copy", [(5, 6, 7, 8)]), (0, 3001, "line", [(0.0, 0.0), (1.0, 1.0)], 0, 1, False, "transparent", [(1, 1, 1, 9)])]
    out = {(x, y): c for _, x, y, *c in table(shapes.paint(canvas(spark, {0: (2, 2)}), relation(spark, rows)))}
    assert out == {(0, 0): [1, 1, 1, 9], (1, 1): [1, 1, 1, 9], (0, 1): [5, 6, 7, 8], (1, 0): [5, 6, 7, 8]}


def test_marks_are_not_sorted_by_pixel_to_find_the_opaque_ones(spark):
    """Hidden marks are dropped where they are made: no window over each pixel's marks, which would sort all of them."""
    rows = [(0, k, "rect", [(0.0, 0.0), (2.0, 2.0)], 0, 1, False, "alpha", [(k, 0, 0, 100)]) for k in range(9)]
    plan = shapes.paint(canvas(spark, {0: (2, 2)}), relation(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [max(" not in plan


def test_curves_of_equal_order_are_not_mixed(spark):
    """Each is drawn by its own steps, once a pixel, the one with the smaller colour first."""
    a, b = [(0.0, 0.0), (3.0, 12.0), (6.0, -5.0), (11.0, 9.0)], [(11.0, 0.0), (2.0, 3.0), (9.0, 8.0), (0.0, 11.0)]
    drawn = [("curve", a, 9, 1, False, "alpha", [(10, 200, 30, 120)]), ("curve", b, 9, 1, False, "alpha", [(200, 10, 60, 90)])]
    df = canvas(spark, {0: (12, 12)})
    assert table(shapes.paint(df, relation(spark, [(0, 5, *s) for s in drawn]))) == table(one_by_one(df, drawn))

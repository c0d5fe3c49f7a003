"""The median cut of joins and group-bys against the one of a single task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import palette
from pixelweave.sources import fixtures


def table(df):
    return sorted((str(r.image_id), r.idx, r.r, r.g, r.b, r.a) for r in df.collect())


@pytest.mark.parametrize("n,use_original,include_alpha", [(16, False, False), (7, True, False), (40, False, True)])
def test_canvas_is_cut_without_a_group(spark, data, n, use_original, include_alpha):
    df = fixtures.canvas(spark, data).withColumn("a", F.pmod(F.col("x") * 5, F.lit(256)).cast("int"))
    one = table(palette.quantize(df, n, use_original, include_alpha))
    assert len(one) > n // 2 and table(palette.quantize(df, n, use_original, include_alpha, in_task=0)) == one


def test_images_of_all_kinds_at_once(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(6):
        spread = (1, 3, 40, 255, 255, 2)[k]
        for i in range(150):
            c = rng.integers(0, spread + 1, 3) if k != 4 else (i, 0, 0)
            rows.append((f"i{k}", 150, 1, i, 0, *map(int, c), 255))
    rows += [("one", 1, 1, 0, 0, 9, 9, 9, 255), ("two", 2, 1, 0, 0, 9, 9, 9, 255), ("two", 2, 1, 1, 0, 8, 9, 9, 0)]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, x int, y int, r int, g int, b int, a int")
    for n in (2, 9):
        one = table(palette.quantize(df, n))
        assert table(palette.quantize(df, n, in_task=0)) == one == table(palette.quantize(df, n, in_task=60))
    assert palette.quantize(df.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        palette.quantize(df, 1)


def test_no_task_gathers_a_bucket(spark, data):
    """A bucket's colours meet in sums of at most 256 rows; the plan of the splits has no Python over colours."""
    df = fixtures.canvas(spark, data)
    counted = df.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.lit(""))
    wanted = spark.createDataFrame([(0, "", 1, counted.agg(F.sum("n")).first()[0])], "image long, at string, channel int, total long")
    found = palette._medians(counted, wanted, ["r", "g", "b"]).collect()
    keys = sorted(((r.g << 24) + (r.r << 16) + (r.g << 8) + r.b, r.n) for r in counted.collect())
    cumulative = np.cumsum([n for _, n in keys])
    assert [(r.median, r.last) for r in found] == [(keys[int(np.searchsorted(cumulative, cumulative[-1] / 2))][0], keys[-1][0])]

"""Joins of rectangles that intersect."""

import random

from pyspark.sql import functions as F

from pixelweave.functions import rects
from pixelweave.plans import registry


def met_in_join(df):
    """Rows that the hash join of a collected `df` made."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if node.nodeName() == "ResultQueryStage":
            nodes.append(node.plan())
        if node.nodeName() == "ShuffledHashJoin":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_pairs_of_copies_meet_once(spark, tmp_path):
    """Orders and parts of two rectangles: the join makes a row for each pair of lists, not of keys; all pairs come out."""
    order, period = 21, 630 * 17 * 11  # keys that far apart have the same rectangle
    x, y, w, h = order % 90 - 3, order // 7 % 90 - 2, order % 17 + 1, order % 11 + 1
    part = next(k for k in range(90) if k * 13 % 90 < x + w and x < k * 13 % 90 + 9 and k * 29 % 90 < y + h and y < k * 29 % 90 + 4)
    spark.range(200).select((F.col("id") * period + order).alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(300).select((F.col("id") * 90 + part).alias("p_partkey"), F.lit(8).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()["q23_intersecting_pairs"](spark, str(tmp_path))
    assert met_in_join(df) == [1]
    assert df.select("rect_id", "part").distinct().count() == df.count() == 200 * 300


def test_lists_salts_and_tasks_lose_no_pair(spark, monkeypatch):
    for name, v in (("LISTED", 3), ("TASK_PAIRS", 40), ("KEY_PAIRS", 20)):
        monkeypatch.setattr(rects, name, v)
    rng = random.Random(5)
    rows = lambda n, copies: [(k, rng.randint(-9, 9), rng.randint(-9, 9), rng.randint(1, 6), rng.randint(1, 6)) for k in range(n)] + [(n + k, 2, -3, 4, 5) for k in range(copies)]
    a, b = rows(60, 25), rows(40, 31)
    listed = lambda v: rects.listed(spark.createDataFrame([*v, (None, 2, -3, 4, 5), (999, None, 0, 1, 1)], "k long, x int, y int, w int, h int"), "k")
    assert listed(a).agg(F.max(F.size("keys"))).first()[0] < 25
    out = rects.intersecting(listed(a), listed(b), 3).select(F.explode("keys").alias("k"), "s_keys").select("k", F.explode("s_keys").alias("s")).collect()
    assert sorted(map(tuple, out)) == sorted((p[0], q[0]) for p in a for q in b if p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4])
    assert rects.intersecting(listed([]), listed(b), 3).count() == 0


def made_by_explodes(df):
    """Rows that each explode of a collected `df` made."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if node.nodeName() == "ResultQueryStage":
            nodes.append(node.plan())
        if node.nodeName() == "Generate":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_pairs_are_not_held_back(spark):
    """The first pair is handed on when the keys of one list are written out, not the product of all lists that meet."""
    near = lambda n, copies: [(k, k // copies % 3, 0, 9, 9) for k in range(n)]
    listed = lambda v: rects.listed(spark.createDataFrame(v, "k long, x int, y int, w int, h int"), "k")
    met = rects.intersecting(listed(near(600, 200)), listed(near(900, 300)), 20).select("keys", "s_keys")
    pairs = rects.paired(met, "k", "s")
    first = pairs.limit(1)
    assert len(first.collect()) == 1
    assert sorted(made_by_explodes(first))[-2:] == [200, 300]
    assert pairs.distinct().count() == pairs.count() == 600 * 900

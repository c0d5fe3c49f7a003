"""Connected components by alternating star contractions, entirely in joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Edges for each task; a small table is spread over few tasks, whatever the number of shuffle partitions.
PER_TASK = 100_000
LEAST_TASKS = 8


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = _both(edges)
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.coalesce(tasks).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long), root being the smallest node reachable.

    Large-star and small-star alternate until nothing changes; the edges are then a forest of stars.
    Nulls and loops (a = b) are no edges; an empty table gives an empty result. The smallest
    neighbours are written before the join that uses them, so both sides of that join come from plain
    exchanges and a hub with very many edges is split by adaptive execution.
    """
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        tasks = max(LEAST_TASKS, mark[0] // PER_TASK)
        edges = cut(_small_star(cut(_large_star(edges, tasks).coalesce(tasks)), tasks).coalesce(tasks))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed for each source, targets follow by water-filling, and every document is taken
floor(rate) times plus once more with the probability of the fraction, decided by a seeded hash. Few or very unequal
documents would miss the target by such draws, so each source draws with the one of 64 seeds whose words come
nearest to it; all seeds are summed in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, packed, table, uniform, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 11
#: Seeds that each source may choose from.
SEEDS = 64
#: Sources at most for which their table is broadcast (under 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_sizes(docs: DataFrame, source: Column | str, size: Column) -> DataFrame:
    """(source, source_size long): one row for each source, null included."""
    source = F.col(source) if isinstance(source, str) else source
    return docs.groupBy(source.cast("string").alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """`sources` with a weight: by code point, null last, the weights in turn.

    Sources are range-partitioned by name and ranked inside each part, so that any number of them is
    ranked without one task holding all.
    """
    n = sources.count()
    parts = max(1, -(-n // 20_000))
    ranged = cut(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    ranked = ranged.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    rank = ranked.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("rank", F.col("within") + F.col("before"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return rank.select("source", "source_size", F.element_at(turn, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight) with target double: `share` of all sizes by weight, no target above
    `most` times its source's size; what a source cannot take goes to the others by weight.

    Each round is one small aggregate over the source table; capped sources only grow in number, so it
    ends. A source without a positive weight gets nothing; if all are capped, the rest stays untaken.
    """
    sources = cut(sources)
    cap, weight = F.lit(most) * F.col("source_size"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else (F.lit(level) * weight > cap)
        spent, open_weight, n = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if n == capped or open_weight <= 0:
            break
        level, capped = (total - spent) / open_weight, n
    return sources.withColumn("target", F.when(weight <= 0, 0.0).otherwise(F.least(F.lit(level or 0.0) * weight, cap)))


def _rate() -> Column:
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    return F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)


def _planned(docs: DataFrame, plan: DataFrame, source_col: str) -> DataFrame:
    """`docs` with the columns of `plan` (__s: the source, ...), of which the source is dropped."""
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return docs.join(side, docs[source_col].cast("string").eqNullSafe(F.col("__s")), "left").drop("__s")


def with_seeds(plan: DataFrame, sized: DataFrame, key_cols: list[str], seed: int = SEED, seeds: int = SEEDS) -> DataFrame:
    """`plan` (source, source_size, target) with seed long: of `seeds` seeds the first whose draws take the words of
    `sized` (source, size, `key_cols`) nearest to the target. A row of sums for each source and task is shuffled."""
    plan = cut(plan.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    rate = _rate()
    drawn = _planned(sized, plan, "source").select(F.col("source").cast("string").alias("source"), "size", (rate - F.floor(rate)).alias("part"), F.xxhash64(*key_cols).alias("key"))
    more = [F.sum(F.when(uniform(seed + k, "key") < F.col("part"), F.col("size")).otherwise(0)).alias(f"n{k}") for k in range(seeds)]
    sums = drawn.groupBy("source").agg(*more)
    met = plan.join(sums, F.col("__s").eqNullSafe(F.col("source")), "left").drop("source")
    off = lambda k: F.abs(F.floor(rate) * F.col("__source_size") + F.coalesce(F.col(f"n{k}"), F.lit(0)) - F.col("__target"))
    best = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(seed + k).cast("long").alias("seed")) for k in range(seeds)]))
    return met.select(F.col("__s").alias("source"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), best["seed"].alias("seed"))


def with_copies(docs: DataFrame, plan: DataFrame, source_col: str, key_cols: list[str]) -> DataFrame:
    """`docs` with __source_size, __target and __copies (int): how often each row is taken by `plan` (with_seeds).

    The rate of a source is target / source_size (0 for an empty source); the fraction decides by a
    hash of `key_cols` and the source's seed, so reruns agree and repeated rows get equal decisions.
    """
    plan = cut(plan.select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("seed").alias("__seed")))
    joined = _planned(docs, plan, source_col)
    rate, key = _rate(), F.xxhash64(*key_cols)
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("__seed").cast("int"), key), 11).cast("double") / F.lit(float(1 << 53))
    more = drawn < rate - F.floor(rate)
    return joined.withColumn("__copies", (F.floor(rate) + F.when(more, 1).otherwise(0)).cast("int")).drop("__seed")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """`docs` mixed to the cyclic `weights` of its sources: each row as often as it is taken (maybe never).

    A row's size is its number of white-space separated words (null text: 0). A null source is a source
    of its own, the last. Rows of no words follow their source's rate. Repeated rows are taken
    alike. An empty table stays empty. All columns stay.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    plan = targets(cyclic_weights(source_sizes(sized, "source", F.col("size")), weights), most, share)
    plan = with_seeds(plan, sized, ["id", "source"], seed)
    rows = docs.select(packed(docs).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    taken = with_copies(rows, plan, "source", ["id", "source"]).where("__copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = targets(cyclic_weights(source_sizes(docs, "source", F.col("size"))))
    taken = with_copies(docs, with_seeds(plan, docs, ["doc_id", "source"]), "source", ["doc_id", "source"])
    return taken.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op4_mix_sources": op4_mix_sources}
#: The Bernoulli copy hangs on Spark's xxhash64, which DuckDB lacks; tests/llm hold targets and totals against brute force.
ORACLE_SQL: dict[str, str] = {}

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the query contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that setting is absent (a local test
    session) a temporary folder takes its place."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there: later steps neither compute it again
    nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not use."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, also where `body` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column | str) -> Column:
    """A reproducible number in [0, 1) for each row, from a hash of `cols`."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def numbered(df: DataFrame, within: Sequence[str], spread: Sequence[str], out: str, per_bucket: int = 4_000, rows: int | None = None) -> DataFrame:
    """Number the rows from 0 without gaps within each value of `within`.

    No task sees more than a bucket: rows are dealt by a hash of `spread`, rows that are equal there by their place
    in the input too, numbered inside (within, bucket), and shifted by the size of the buckets before theirs;
    buckets are summed a thousand at a time. The dealt rows are written once, so a lost executor cannot change
    them. Equal input rows are interchangeable.
    """
    n = df.count() if rows is None else rows
    buckets = max(1024, -(-n // per_bucket))
    b, k, i = (free_name(df, x) for x in ("bucket", "thousand", "before"))
    first = F.pmod(F.xxhash64(F.lit(7), *spread), F.lit(buckets)).cast("int")
    copies = F.pmod(F.monotonically_increasing_id(), F.lit(61)).cast("int")
    same = Window.partitionBy(*within, b)
    df = cut(df.withColumn(b, first).withColumn(i, copies))
    crowded = cut(df.groupBy(*within, b).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 4 * per_bucket).select(F.col(b).alias("__b")).distinct())
    if not crowded.isEmpty():  # rows equal in `spread` share a hash; their place deals them on
        hot = df.join(crowded, F.col(b) == F.col("__b"), "left_semi").withColumn(b, F.pmod(F.col(b) + F.col(i) * F.lit(max(1, buckets // 61)), F.lit(buckets)).cast("int"))
        df = cut(df.join(crowded, F.col(b) == F.col("__b"), "left_anti").unionByName(hot))
    df = df.drop(i)
    sizes = cut(df.groupBy(*within, b).agg(F.count(F.lit(1)).alias("__n")).withColumn(k, F.floor(F.col(b) / 1024).cast("int")))
    upto = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    thousands = sizes.groupBy(*within, k).agg(F.sum("__n").alias("__n"))
    over = Window.partitionBy(*within).orderBy(k) if within else Window.orderBy(k)
    thousands = thousands.withColumn("__first", upto(over)).drop("__n")
    inner = sizes.withColumn("__before", upto(Window.partitionBy(*within, k).orderBy(b))).drop("__n")
    shift = _joined(inner, thousands, [*within, k]).withColumn("__before", F.col("__before") + F.col("__first")).drop("__first", k)
    left = df.withColumn(out, F.row_number().over(same.orderBy(*spread)).cast("long") - 1)
    return _joined(left, shift, [*within, b]).withColumn(out, F.col(out) + F.col("__before")).drop("__before", b)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on `keys`, nulls being equal; the keys stay once."""
    renamed = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, "inner").drop(*[f"__k{i}" for i in range(len(keys))])

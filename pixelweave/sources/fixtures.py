"""Images derived from the analytic tables: the inputs of the registered queries.

Pixel rows are (image_id, width, height, x, y, r, g, b, a). They carry their image's size, so point and
geometry operators need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ("image_id", "width", "height", "x", "y", "r", "g", "b", "a")


def _byte(e: Column) -> Column:
    return F.least(F.greatest(F.floor((e.cast("double") + 1.0) * 127.5 + 0.5), F.lit(0)), F.lit(255)).cast("int")


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 2 image of each 64-value embedding: four values a pixel, alpha stretched to reach 0 and 255."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    p = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    part = lambda c: _byte(F.element_at("embedding", F.col("k") * 4 + 1 + c))
    p = p.select("image_id", F.lit(8).alias("width"), F.lit(2).alias("height"), (F.col("k") % 8).cast("int").alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), part(3).alias("v"))
    turn = F.pmod(F.col("image_id") + F.col("x") + F.col("y"), F.lit(5))
    return p.select("image_id", "width", "height", "x", "y", "r", "g", "b", F.when(turn == 0, 0).when(turn == 1, 255).otherwise((F.col("v") * 7) % 256).cast("int").alias("a"))


#: Widths of `mixed`, by image_id modulo their number; each times its height is 16.
MIXED_WIDTHS = (8, 4, 2, 16, 1)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of `rgba` as images of five sizes: 8 x 2, 4 x 4, 2 x 8, 16 x 1 and 1 x 16."""
    w = F.get(F.array(*map(F.lit, MIXED_WIDTHS)), F.pmod("image_id", F.lit(len(MIXED_WIDTHS))).cast("int"))
    k = F.col("y") * 8 + F.col("x")
    return rgba(spark, sf_dir).select("image_id", w.alias("width"), F.floor(F.lit(16) / w).cast("int").alias("height"), (k % w).cast("int").alias("x"), F.floor(k / w).cast("int").alias("y"), "r", "g", "b", "a")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, x, y, v): an 8 x 8 single-channel image of each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), _byte(F.col("e")).alias("v"))


def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image 100 pixels wide of all events, a pixel each; its height follows the table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").agg(((F.max("event_id") / 100).cast("int") + 1).alias("height"))
    return e.crossJoin(F.broadcast(rows)).select(  # one row
        F.lit(0).cast("long").alias("image_id"), F.lit(100).alias("width"), "height",
        (F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("event_id") / 100).cast("int").alias("y"),
        F.pmod(F.floor("value"), F.lit(256)).cast("int").alias("r"), F.pmod("user_id", F.lit(256)).cast("int").alias("g"), F.pmod(F.col("event_id") * 37, F.lit(256)).cast("int").alias("b"), F.lit(255).alias("a"),
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rect_id, x, y, w, h) of each order, some reaching outside."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("rect_id"))
    k = F.col("rect_id")
    return o.select("rect_id", (k % 90 - 3).cast("int").alias("x"), (F.floor(k / 7) % 90 - 2).cast("int").alias("y"), (k % 17 + 1).cast("int").alias("w"), (k % 11 + 1).cast("int").alias("h"))


#: DuckDB twins; a query's SQL starts with `WITH` and these.
BYTE = "CAST(least(greatest(floor((CAST({0} AS DOUBLE) + 1.0) * 127.5 + 0.5), 0), 255) AS INT)"
RGBA_SQL = f"""px0 AS MATERIALIZED (SELECT vec_id AS image_id, CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y, {BYTE.format('embedding[4*k+1]')} AS r, {BYTE.format('embedding[4*k+2]')} AS g, {BYTE.format('embedding[4*k+3]')} AS b, {BYTE.format('embedding[4*k+4]')} AS v
  FROM embeddings, (SELECT unnest(range(0, 16)) AS k)),
px AS MATERIALIZED (SELECT image_id, 8 AS width, 2 AS height, x, y, r, g, b, CAST(CASE (image_id + x + y) % 5 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE (v * 7) % 256 END AS INT) AS a FROM px0)"""
MIXED_SQL = RGBA_SQL + """, mx AS MATERIALIZED (SELECT image_id, w AS width, 16 // w AS height, CAST((y * 8 + x) % w AS INT) AS x, CAST((y * 8 + x) // w AS INT) AS y, r, g, b, a
  FROM (SELECT *, CASE image_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 16 ELSE 1 END AS w FROM px))"""
GRAY_SQL = f"""gy AS MATERIALIZED (SELECT vec_id AS image_id, 8 AS width, 8 AS height, CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y, {BYTE.format('embedding[k+1]')} AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS k))"""
CANVAS_SQL = """cv AS (SELECT CAST(0 AS BIGINT) AS image_id, 100 AS width, CAST((SELECT max(event_id) // 100 + 1 FROM events) AS INT) AS height, CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y,
  CAST(CAST(floor(value) AS BIGINT) % 256 AS INT) AS r, CAST(user_id % 256 AS INT) AS g, CAST(event_id * 37 % 256 AS INT) AS b, 255 AS a FROM events)"""
RECTS_SQL = """rc AS (SELECT o_orderkey AS rect_id, CAST(o_orderkey % 90 - 3 AS INT) AS x, CAST((o_orderkey // 7) % 90 - 2 AS INT) AS y, CAST(o_orderkey % 17 + 1 AS INT) AS w, CAST(o_orderkey % 11 + 1 AS INT) AS h FROM orders)"""

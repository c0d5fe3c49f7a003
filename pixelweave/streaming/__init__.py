"""Image files as a stream: new files of a folder become pixel rows. An addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def pixels(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Pixels of the files that arrive under `path`, without state."""
    return files.load(files.stream_files(spark, path), fmt)


def histograms(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Running colour counts over all files seen so far; for output modes complete and update."""
    return pixels(spark, path, fmt).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("count"))

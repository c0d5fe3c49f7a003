"""Raster analytics on Spark: pixels are rows, images are keyed relations."""

"""Registered queries of the raster engine and their SQL twins, by inventory number."""

from __future__ import annotations

from collections.abc import Callable

from . import color_queries, drawing_queries, file_queries, image_queries, indexed_queries, point_queries, size_queries

MODULES = [point_queries, image_queries, indexed_queries, color_queries, drawing_queries, file_queries, size_queries]


def queries() -> dict[str, Callable]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

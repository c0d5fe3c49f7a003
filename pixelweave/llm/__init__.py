"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. `queries()` and `oracle_sql()`
gather the registered queries of its modules.
"""

from __future__ import annotations

from collections.abc import Callable


def _modules() -> list:
    from . import registry

    return registry.MODULES


def queries() -> dict[str, Callable]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}

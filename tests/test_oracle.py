"""Every registered query of the engine against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from pixelweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    found = duck.sql(SQL[name])
    at = [list(found.columns).index(c) for c in cols]
    assert sorted(found.columns) == cols
    assert ordered(mine) == ordered([tuple(plain(r[i]) for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0

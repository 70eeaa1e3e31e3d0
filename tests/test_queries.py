"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quarrymill import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert found == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

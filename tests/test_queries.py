"""Queries of the engine against their SQL in DuckDB, over the driver's small tables."""

import duckdb
import pytest

from lamina.oracle import SQL
from lamina.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents conversations labels".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([float(v[k]) if isinstance(v[k], float) else v[k] for k in order]) for v in values), sorted(columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), [c[0] for c in cursor.description])

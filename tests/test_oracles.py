"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from corpusflow.catalog.registry import QUERIES, SQL

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, expected)

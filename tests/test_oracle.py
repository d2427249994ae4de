"""Every core query against the same in SQL."""

import duckdb
import pytest

from sheafmill.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(map(plain, row))) for row in frame.select(columns).collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want
    assert got

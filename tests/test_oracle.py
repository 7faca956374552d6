"""Every registered query against its DuckDB oracle on the smoke data:
same column names, row count and (order-insensitive) values."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.check_oracle import TABLES, norm


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    dcols = rel.columns
    drows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
    assert sorted(scols) == sorted(dcols)
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    assert sorted(tuple(r[i] for i in order) for r in srows) == \
        sorted(tuple(r[i] for i in dorder) for r in drows)

"""Every query with reference SQL gives the same rows in both engines on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from armarium.plans import catalog
from check import TABLES, rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_names_line_up():
    assert set(SQL) <= set(QUERIES)
    assert set(catalog.collect("QUERIES")) - set(SQL) == {"vm3_guarded_match", "mj14_simhash_fnv"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

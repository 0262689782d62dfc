import duckdb
import pytest

from rasterquarry.plans import registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    spark.catalog.clearCache()
    want = tables.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str) and rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())

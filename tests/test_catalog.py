"""Every registered query against its DuckDB oracle, and a stable schema for those without one."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewheel import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, sf_dir, name):
    assert rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from stockweave.plans import catalog_queries

QUERIES, ORACLES = catalog_queries.queries(), catalog_queries.oracle_sql()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: They depend on titles that the smallest table may lack.
LARGER = ("agg_sampling", "rlx_correct_retry", "rlx_staged", "rlx_sufficient", "meta_trace", "mat_prediction", "ext_query_plugins")


def _duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def ducks():
    return {f: _duck(f) for f in (SF, "/root/testdata/sf0.01")}


def rows(df):
    df = df[sorted(df.columns)].astype(str)
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracles_rows(spark, ducks, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else SF
    got, want = QUERIES[name](spark, folder).toPandas(), ducks[folder].sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows_and_repeats_them(spark, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    assert got and got == rows(QUERIES[name](spark, SF).toPandas())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

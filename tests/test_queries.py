"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from equiscope.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def cells(df):
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(one, r)) for r in df.reindex(sorted(df.columns), axis=1).astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert cells(catalog.QUERIES[name](spark, sf).toPandas()) == cells(duck.execute(catalog.ORACLES[name]).df())
    spark.catalog.clearCache()


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

"""Every query with an oracle returns what DuckDB makes of its SQL, at the smallest scale."""

import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quantloom.catalog_of_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return None
    if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.9g}"
    return str(v).removesuffix(" 00:00:00")


def canonical(df):
    df = df[sorted(df.columns)].apply(lambda c: c.astype(object).map(plain))
    return sorted(map(tuple, df.itertuples(index=False)), key=repr), list(df.columns)


@pytest.fixture(scope="module")
def duck(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, duck, name):
    got = canonical(QUERIES[name](spark, sf_dir).toPandas())
    want = canonical(duck.execute(ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert len(QUERIES[name](spark, sf_dir).columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())

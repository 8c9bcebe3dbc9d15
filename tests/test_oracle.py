"""Registered queries vs their SQL oracles on the smallest driver tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from blotter import plans
from blotter.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = plans.oracle_sql()


def _canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _canon(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = con.sql(ORACLES[name]).df()
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"district", "label", "day", "hour", "alym", "apm", "apy", "ata"} <= set(df.columns)

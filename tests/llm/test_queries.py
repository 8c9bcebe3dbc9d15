"""The registered queries against their SQL on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest
from blotter.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    rows = [tuple(dict(zip(want.columns, r))[c] for c in cols) for r in want.fetchall()]
    got = [tuple(r[c] for c in cols) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_one_query_for_each_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names

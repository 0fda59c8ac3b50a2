"""Every registered query with a SQL twin matches DuckDB on the small tables."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare  # noqa: E402
from ebb.sources.tables import TABLES, table_path  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = table_path(SF, t)
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    r = compare(s, d)
    assert r["cols_match"], r
    assert r["rows"][0] == r["rows"][1], r
    assert r["exact"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0

"""Every query of the search engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from kindred.plans.oracle import ORACLE_SQL
from kindred.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(row):
    return tuple(round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(_plain, got), key=key) == sorted((_plain(r[i] for i in at) for r in found.fetchall()), key=key)

"""Queries that SQL can express against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from kindred.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _differing(got: list[dict], said: list[dict]) -> list:
    """Rows without a counterpart; doubles may differ by one in the last rounded place."""
    by = lambda r: str(next(iter(r.values())))
    pairs = zip(sorted(got, key=by), sorted(said, key=by), strict=True)
    same = lambda x, y: abs(x - y) < 2e-6 if isinstance(x, float) else x == y and type(x) is type(y)
    return [(g, s) for g, s in pairs if g.keys() != s.keys() or not all(same(g[k], s[k]) for k in g)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    got = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert got and _differing(got, [dict(zip(columns, r, strict=True)) for r in found.fetchall()]) == []

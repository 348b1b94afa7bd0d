"""The queries of the subpackage with SQL against DuckDB over the smallest tables."""

import math

import pytest
from test_oracles import DATA, duck, table_of  # noqa: F401

from zonalis.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)

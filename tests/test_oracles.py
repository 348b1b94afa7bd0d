"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import pytest

from zonalis import queries_analytics, queries_core, queries_relational

DATA = "/root/testdata/sf0.001"
CASES = [(m, n) for m in (queries_core, queries_relational, queries_analytics) for n in m.ORACLES]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or x != x or str(x) in ("NaT", "<NA>"):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 7) if isinstance(x, float) and math.isfinite(x) else x


def table_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_matches_its_sql(spark, duck, module, name):
    df = module.QUERIES[name](spark, DATA)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(module.ORACLES[name])
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(*(x[1] for x in (got, want))):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)

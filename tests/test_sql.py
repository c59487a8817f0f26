"""Every core query with SQL gives the SQL's rows."""

import os

import pytest

from pagewright import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    cursor = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)
    rows = catalog.queries()[name](spark, DATA).collect()
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str)
    assert got == want

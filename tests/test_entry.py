import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["q_merge", "q_fingerprints", "q_opengraph", "q_css_cards", "q_schedule", "p5_opengraph"])
def test_against_sql(spark, name):
    import duckdb

    from pagewright import catalog

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    spark_rows = sorted(map(str, (tuple(r[k] for k in columns) for r in got.collect())))
    cursor = c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    sql_rows = sorted(map(str, (tuple(dict(zip(names, r, strict=True))[k] for k in columns) for r in cursor.fetchall())))
    assert spark_rows == sql_rows

"""Every training-data query on empty tables, and on tables with nulls, repeated rows and extra columns."""

import os

import pytest

from pagewright.llm import queries
from tests import edges


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    if not os.path.isdir(edges.DATA):
        pytest.skip("no test data here")
    return edges.empty(tmp_path_factory.mktemp("empty")), edges.odd(tmp_path_factory.mktemp("odd"))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_and_odd_tables(spark, folders, name):
    empty, odd = folders
    rows = queries.queries()[name](spark, empty).collect()
    assert not rows or name in ("p3_wrong", "p7_ways", "p10_rejected")
    queries.queries()[name](spark, odd).collect()

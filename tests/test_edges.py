"""Every core query on empty tables, and on tables with nulls, repeated rows and extra columns."""

import os

import pytest

from pagewright import catalog
from tests import edges

QUERIES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    if not os.path.isdir(edges.DATA):
        pytest.skip("no test data here")
    return edges.empty(tmp_path_factory.mktemp("empty")), edges.odd(tmp_path_factory.mktemp("odd"))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_and_odd_tables(spark, folders, name):
    for d in folders:
        catalog.queries()[name](spark, d).collect()

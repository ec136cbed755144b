"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    verdict, _, _ = check(spark, con, name, SF)
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 48

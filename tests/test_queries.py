"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
oracle.load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle.QUERIES))
def test_query_matches_oracle(spark, con, name):
    good, note = oracle.compare(spark, con, SF_DIR, name)
    assert good, note


def test_every_query_has_an_oracle():
    assert set(oracle.QUERIES) == set(oracle.ORACLES)


def test_entry(spark):
    import __spark_entry__ as contract

    result = contract.entry(spark)
    assert result.columns == ["review_id", "files", "findings", "critical", "project_score"]
    assert result.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())

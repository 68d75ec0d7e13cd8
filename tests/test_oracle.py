"""Every query with a SQL twin must give the same rows; every other query must run.

Two queries boost for minutes and have no twin; ``tests/test_boosting.py`` holds their parts against plain loops.
"""

import pytest

import __spark_entry__ as entry_module
import check
from conftest import SF

SLOW = {"m9_gradient_boosting", "m11_fitted_vote"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - SLOW))
def test_query(spark, con, name):
    result, _, _ = check.compare(spark, con, SF, name)
    assert not result.startswith("FAIL"), result


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

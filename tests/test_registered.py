"""Every registered query against its SQL on the smallest scale."""

import pytest

from compare import compare, connect
from tickwright.plans.registry import CHECKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(CHECKS))
def test_agrees_with_sql(name, spark, con):
    assert CHECKS[name].sql is not None
    rows, problem = compare(CHECKS[name], spark, con, SF)
    assert problem is None, problem

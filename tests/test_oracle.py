"""Every registered query against its SQL twin on the smallest tables, and its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

from cairnbook.plans import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in ORACLES:
        assert check_oracle.compare(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_names_are_unique_and_paired():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100

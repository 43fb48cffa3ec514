"""Every core query against its SQL; queries without SQL must run with a stable schema."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from vdjlake.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_sql(spark, name):
    oracle.same(spark, registry.queries()[name], registry.sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, oracle.DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_names():
    assert set(registry.sql()) <= set(registry.queries())

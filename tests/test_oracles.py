"""Every registered market query against its SQL twin."""

import pytest
from compare import assert_same

from tickweave import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

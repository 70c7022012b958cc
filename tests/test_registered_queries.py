"""Every registered query against its SQL on the smallest tables, and rules all plans must keep."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as contract
from paylattice.oracle import statements
from paylattice.registry import QUERIES

SQL = statements()
NO_SQL = {
    "als_candidates", "ann_recall", "ann_topk_clusters", "fm_pair_scores", "offline_evaluation_als",
    "offline_evaluation_als_reverse", "topic_indexed", "topic_weights", "ann_topk_forest",
    "ann_recall_forest", "fm_later_metrics",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_keys():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert contract.entry(spark).count() > 0

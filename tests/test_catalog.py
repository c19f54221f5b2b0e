"""Every registered query against its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry_point
from flowsift.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect

MODELS = {"isolation_scores", "trained_predictions", "boosted_predictions", "scored_flows", "stream_scores"}


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) - set(ORACLE) == MODELS
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, db, name):
    assert compare(QUERIES[name](spark, sf), db, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_queries_give_rows(spark, sf, name):
    assert not QUERIES[name](spark, sf).isEmpty()


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1000

"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from orderlens.plans.oracles import ORACLES
from orderlens.plans.queries import QUERIES
from tools.compare import compare, open_duckdb

HEAVY = {"f19_logistic_scores", "f26_fitted_comparison", "g10_fitted_decision"}
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return open_duckdb(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    diff = compare(E.queries()[name](spark, sf), con, E.oracle_sql()[name])
    assert diff is None, diff


def test_every_query_has_oracle_or_is_model_fit():
    assert set(QUERIES) - set(ORACLES) == HEAVY
    assert set(QUERIES) <= set(E.queries())


def test_orphan_scores_are_found(spark, sf):
    assert QUERIES["g4_orphan_scores"](spark, sf).count() > 0


def test_fitted_scores_reach_the_decision_table(spark, sf):
    got = QUERIES["g10_fitted_decision"](spark, sf)
    test_side = QUERIES["f6_split_profile"](spark, sf).filter("split = 'test'").first().orders
    assert got.count() == test_side and got.filter("revenue is null or risk_level is null").count() == 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "late_delivery_rate" in df.columns

"""Every registered query against its SQL oracle at the smallest scale."""

import pytest
from compare import difference, duck
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from taskspan.plans import queries as plans
from taskspan_oracle.sql import ORACLES

ROWS_ONLY = {"quantile_boost_fit", "quantile_boost_predict", "scored_table", "run_record"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_but_the_model_has_an_oracle():
    assert set(plans.QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(plans.QUERIES)
    assert set(plans.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_model_queries_have_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, connection, name):
    assert difference(queries()[name](spark, SF), connection, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0

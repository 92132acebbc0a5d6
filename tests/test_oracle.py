"""Every query against its SQL: on the small tables, and the payment problems on dirty and empty ones too."""

import pytest
from compare import assert_same, connect, rows_of
from conftest import DATA

from tidemark.queries import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()
PROBLEMS = sorted(n for n in QUERIES if n[0] == "p" and n[1].isdigit())


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name], SQL[name], spark, DATA, con)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", PROBLEMS)
def test_dirty_tables(spark, dirty_tables, name):
    """Nulls in any column, repeated rows, extra columns with the operators' own names."""
    if name == "p1_exactly_once":
        assert QUERIES[name](spark, dirty_tables).count() > 0
        return
    assert_same(QUERIES[name], SQL[name], spark, dirty_tables, connect(dirty_tables))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"fraud_model", "model_gates", "forecast_selection", "forecast_holdouts", "freshness_health", "load_once", "payment_events_stream", "cdc_stream", "late_stream"}))
def test_empty_tables(spark, empty_tables, name):
    """No rows in, no crash; keyed results are empty."""
    cols, rows = rows_of(QUERIES[name](spark, empty_tables))
    if name in PROBLEMS:
        assert not rows

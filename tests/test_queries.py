"""Every registered query of the engine against its SQL, at the smallest size."""

import pytest

from flicker.registry import ORACLE, QUERIES

from .conftest import DATA, assert_same


#: These need validation runs, which the smallest size hasn't.
LARGER = ("test_of_selected_small", "summary_table", "decision_of_selected", "decision_against_all", "paired_all_methods", "same_t_of_selected")


@pytest.mark.parametrize("name", sorted(set(ORACLE) - set(LARGER)))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLE[name])


@pytest.mark.parametrize("name", LARGER)
def test_larger_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/sf0.01/events.parquet'")
    assert_same(QUERIES[name](spark, f"{DATA}/sf0.01"), con, ORACLE[name])


def test_plan_of_selected(spark):
    rows = QUERIES["test_of_selected"](spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == 10 and len({r["method"] for r in rows}) == 10
    assert all(0 <= r["brier"] <= 1 for r in rows)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every query with SQL against DuckDB, and the contract with the driver."""

import pytest
from oracle import assert_equal

import __spark_entry__
from lexiflow.queries import core, stored, whole

assert stored and whole  # their queries are registered with those of core
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, name):
    assert_equal(spark, core.QUERIES[name], core.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 200


def test_text_replacement_is_one_projection(spark):
    plan = core.QUERIES["phrase_replace"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan

"""Each query of the engine against its SQL."""

import pytest
from oracle import spark_rows, sql_rows

from weftflow import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert spark_rows(df) == sql_rows(queries.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", ["flagship", "filter_formula", "join_full", "pivot_sum", "fill_mode"])
def test_plans_stay_in_the_jvm(spark, name, capsys):
    queries.QUERIES[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, capsys):
    queries.QUERIES["flagship"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,25.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1].splitlines()[0]

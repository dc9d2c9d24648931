"""Every registered query runs on the smallest tables and equals its SQL twin where it has one."""

import re

import pytest
from oracle import compare, connect

from cmdprism.catalog import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Operators that are expressions, joins and aggregates only: no Python workers in their plans.
NO_PYTHON = re.compile(
    r"^(a1|a2|a3|b\d|c2|d\d|e\d|f\d|g\d|h2|h10_stacked_score|h13|h15_compare_models|h17|h3|i[12356]|i4_linear|j\d|k\d|flagship)"
)


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, sf_dir, name):
    check = check_plan if NO_PYTHON.match(name) else None
    assert compare(spark, con, name, all_queries()[name], all_oracles().get(name), sf_dir, check) is None


def test_twins_belong_to_queries():
    assert set(all_oracles()) <= set(all_queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}

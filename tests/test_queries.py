"""Every registered query against its checking SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_no_sql_without_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ratios_are_spread_over_tasks(spark):
    plan = entry.queries()["name_similarity"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert "RepartitionByExpression" in plan.toString()


@pytest.mark.parametrize("name", ["resolve_tickers", "tag_mentions", "resolver_accuracy"])
def test_resolver_does_not_go_back_to_the_part_table(spark, name):
    assert not [f for f in entry.queries()[name](spark, SF).inputFiles() if "part.parquet" in f]

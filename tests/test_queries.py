"""Every registered query at the smallest scale against its SQL, and properties of the profiles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from check_oracle import compare, open_tables
from stackloom.plans import inputs
from stackloom.plans.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query_equals_sql(spark, tables, name):
    verdict = compare(spark, tables, FOLDER, name, entry_point.queries()[name], entry_point.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["function", "self_value", "cumulative_value"]


def test_profile_properties(spark):
    t = Tables(spark, FOLDER)
    from stackloom.operators.profiles import profile_by_function
    profile = profile_by_function(inputs.cpu_samples(t), inputs.locations(t)).persist()
    assert profile.where("self_value > cumulative_value").count() == 0
    assert profile.agg(F.sum("self_value")).first()[0] == inputs.cpu_samples(t).agg(F.sum("value")).first()[0]

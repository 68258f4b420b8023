import pytest

import __spark_entry__ as contract
from compare import compare, connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_comparison_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, db, sf, name):
    assert compare(spark, db, sf, name) is None


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "roc_auc" in df.columns

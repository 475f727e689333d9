"""Every registered query that SQL can express equals its SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    problem = difference(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)

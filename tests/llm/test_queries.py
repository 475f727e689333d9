"""Every registered query with SQL equals it; the others run over the whole small tables."""

import pytest

from clearfold.llm.queries import CHECKS
from compare import difference, duck

BY_NAME = {c.name: c for c in CHECKS}


@pytest.mark.parametrize("name", [n for n, c in BY_NAME.items() if c.sql])
def test_matches_sql(spark, sf_dir, name):
    problem = difference(BY_NAME[name].run(spark, sf_dir), duck(sf_dir), BY_NAME[name].sql)
    assert problem is None, problem

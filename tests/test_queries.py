"""Every query with SQL gives the rows of its SQL."""

import pytest

from factloom.plans import registry

from .oracle import SF, same

ORACLE, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    QUERIES[name](spark, SF).collect()

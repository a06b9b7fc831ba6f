"""Every registered query against its SQL, and that each reads the given tables."""

import pytest

from radiolake.plans import registry
from tests.oracle import both

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, QUERIES[name], SQL[name])
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Every registered query of the library against its SQL, and those without SQL for the rows they must have."""

import pytest

from plantlens.plans import queries as own

from .compare import assert_same

WITH_SQL = sorted(own.oracle_sql())
WITHOUT_SQL = sorted(set(own.queries()) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf_dir, duck, name):
    assert_same(own.queries()[name](spark, sf_dir), duck.sql(own.oracle_sql()[name]))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, sf_dir, name):
    assert own.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(own.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

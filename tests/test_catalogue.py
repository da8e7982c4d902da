"""Every query against its SQL on the smallest tables."""

import pytest
from support import TINY, rows_of

from gristmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, TINY).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, TINY).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

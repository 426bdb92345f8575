"""Every registered query against its SQL in DuckDB, and those without SQL for their rows."""

import pytest

from docketspark.plans import catalogue

from .oracle import duck, spark_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_the_oracle(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, SMALL)) == duck(catalogue.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

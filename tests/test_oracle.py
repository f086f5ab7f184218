"""Every core query against its SQL on the smallest tables."""

import pytest
from oracle import compare

from heddle.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    got, expected = compare(df, catalog.ORACLES[name], small)
    assert got == expected


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.dtypes == __spark_entry__.entry(spark).dtypes


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

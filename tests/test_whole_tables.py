"""Queries that give each key of their table a row."""

import pytest

from heddle.plans import catalog

KEYS = {
    "score_mentions": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]),
    "attribution": ("lineitem", ["l_orderkey"]),
    "section_order": ("events", ["user_id"]),
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_each_key_has_a_row(spark, small, name):
    table, key = KEYS[name]
    rows = spark.read.parquet(f"{small}/{table}.parquet").select(*key).distinct().count()
    assert catalog.QUERIES[name](spark, small).count() == rows

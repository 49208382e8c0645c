"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare

from runlens.queries import all_queries, all_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()
# nothing in the smallest tables matches these
EMPTY_AT_SMALLEST = {"journal_range_scan"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    ok, message, _ = compare(spark, name, QUERIES[name], SQL.get(name), SF)
    assert ok or (name in EMPTY_AT_SMALLEST and message.startswith("rows=0")), message


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)

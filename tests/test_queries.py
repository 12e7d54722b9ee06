"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from rowsmith.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    if name in ORACLES:
        result = compare.difference(spark, SF_DIR, name, QUERIES[name], ORACLES[name], connection)
        assert result in (None, "EMPTY"), result
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["kind", "table_name", "column_name", "row_key"]

"""Every query with a SQL form agrees with DuckDB on the smallest tables, and has rows there."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tools.compare import compare

from .conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def reports(spark):
    """All comparisons, a few side by side: most of a small query is waiting."""
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(ORACLES, pool.map(lambda name: compare(name, spark, SF, QUERIES[name], ORACLES[name]), ORACLES)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(reports, name):
    assert reports[name].startswith("ok"), reports[name]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

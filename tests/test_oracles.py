"""Every core query that has SQL, against DuckDB; the rest must give rows."""

import pytest

from fluxspan.plans import catalog
from tests.conftest import TESTDATA


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, oracle, name):
    oracle(spark, catalog.QUERIES, catalog.SQL, name)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, name):
    if not TESTDATA.exists():
        pytest.skip("no test data here")
    assert catalog.QUERIES[name](spark, str(TESTDATA / "sf0.001")).count() > 0


def test_entry_has_sql_only_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in entry.queries()

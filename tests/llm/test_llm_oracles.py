import pytest

from fluxspan.llm import queries
from tests.conftest import TESTDATA


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, oracle, name):
    oracle(spark, queries.QUERIES, queries.SQL, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, name):
    if not TESTDATA.exists():
        pytest.skip("no test data here")
    assert queries.QUERIES[name](spark, str(TESTDATA / "sf0.001")).count() > 0

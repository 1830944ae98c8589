"""Every corpus query that SQL can express against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

from tripweave.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE[name]) == []

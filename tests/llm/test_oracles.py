import pytest
from quarry.llm import queries

from parity import connect, differ


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    assert differ(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name]) is None

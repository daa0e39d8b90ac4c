import pytest

from compare import assert_equal, tables
from yieldloom.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_equal(queries.queries()[name](spark, SF), tables(SF), oracle.oracle_sql()[name])

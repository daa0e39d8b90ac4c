import pytest

from compare import assert_equal, tables
from yieldloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    assert_equal(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])

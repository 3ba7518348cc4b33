import pytest

from tests.compare import differs, duck
from timeloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    assert differs(spark, duck(small), name, QUERIES[name], ORACLE_SQL[name], small) is None

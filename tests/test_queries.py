import pytest

from timeloom.plans.registry import ORACLE_SQL, QUERIES

from .compare import differs, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    if name in ORACLE_SQL:
        assert differs(spark, con, name, QUERIES[name], ORACLE_SQL[name], small) is None
    else:
        assert QUERIES[name](spark, small).count() > 0

import pytest


@pytest.fixture(autouse=True, scope="module")
def _free_tables(spark):
    """What the operators wrote is deleted after each module."""
    yield
    from timeloom.llm.storage import release

    release(spark)

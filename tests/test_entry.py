import __spark_entry__ as E


def test_entry_and_registries(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns
    assert set(E.oracle_sql()) <= set(E.queries())

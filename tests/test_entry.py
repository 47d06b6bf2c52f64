import __spark_entry__


def test_flagship_and_names(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["rid", "passed", "n", "excess", "y", "x"] and out.count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

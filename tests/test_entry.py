import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "src", "label", "fold", "text", "model_a", "model_b", "A_log", "B_log", "tie_log"]
    assert df.count() > 0

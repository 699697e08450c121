import __spark_entry__ as se


def test_entry_and_registry(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert rows and rows[0].top_i == 1
    hr = [r.hit_rate for r in rows]
    assert hr == sorted(hr)                       # hit-rate is non-decreasing
    qs, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30


def test_every_registered_query_runs_on_smoke_data(spark):
    from conftest import SF
    for name, fn in se.queries().items():
        df = fn(spark, SF)
        assert df.count() >= 0, name
        assert len(df.columns) == len(set(df.columns)), name     # unambiguous column names

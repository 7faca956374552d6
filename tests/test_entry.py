"""Driver contract: entry() runs; every registered query runs on sf0.001;
oracle keys are a subset of the query keys."""

import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "whitelisted_ips" in df.columns


def test_oracle_keys_subset_and_aliases():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_every_query_runs_on_smoke_data(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        cols = df.columns
        assert len(cols) == len(set(cols)), name
        df.write.format("noop").mode("overwrite").save()

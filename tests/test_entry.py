"""Driver contract: entry runs, every oracle has a query."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["symbol", "close", "volume", "regime", "marker_final_score", "label"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

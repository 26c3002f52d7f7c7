"""The driver's contract."""

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["o_orderkey", "o_totalprice", "c_name", "c_nationkey"] and 0 < rows.count() <= 50

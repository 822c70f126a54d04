"""The driver contract."""

import __spark_entry__ as E


def test_names_match():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry(spark):
    assert E.entry(spark).count() > 0

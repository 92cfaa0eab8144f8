import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_flagship_counts(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 45
    assert sum(r.label for r in rows) == 18


def test_every_query_has_name_match(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40

"""Every query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import DATA, plain

from quillstack import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    if name in plans.SQL:
        assert plain(got.toPandas()) == plain(duck.sql(plans.SQL[name]).df())
    else:
        assert got.columns
        got.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "total" in entry.entry(spark).columns

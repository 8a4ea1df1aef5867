from __future__ import annotations

import pytest
from compare import DATA, connect, same

from caloris import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(catalog.QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

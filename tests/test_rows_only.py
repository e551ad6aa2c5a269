"""Every registered query without an SQL twin runs end to end on the small fixture and yields rows."""

import pytest

from conftest import SMALL
from retentia.plans.catalog import REGISTRY

ROWS_ONLY = sorted(name for name, e in REGISTRY.items() if not e.sql)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = REGISTRY[name].build(spark, SMALL)
    n = df.count()
    assert n > 0, name
    assert len(df.columns) == len(set(df.columns))

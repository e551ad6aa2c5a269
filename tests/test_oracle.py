"""Every registered query with a SQL twin matches DuckDB on the small fixture (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from retentia.plans.catalog import REGISTRY
from tools.check_oracle import digest

SQL = {name: e.sql for name, e in REGISTRY.items() if e.sql}
QUERIES = {name: e.build for name, e in REGISTRY.items()}

# Those that fit a model.
ROWS_ONLY = {"model_comparison", "feature_importance", "score_latest", "explain_shapley", "permutation_importance",
             "daily_run", "batch_score_file", "stream_score"}


def test_every_query_registered_with_docs():
    assert len(QUERIES) >= 80
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    for name, fn in QUERIES.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, df.columns)[0] == digest(drows, dcols)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["risk_category", "players"]

"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from trialweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).replace({"None": "nan", "<NA>": "nan", "-0.0": "0.0"}).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["box_neighbours", "sphere_neighbours", "searchlight_effect", "sphere_dissimilarity"])
def test_neighbours_are_not_broadcast(spark, name):
    assert "Broadcast" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_queries_stand_alone(monkeypatch):
    """Whatever of the training-data operators cannot be imported, the core queries are there."""
    import importlib
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("trialweave.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "trialweave.llm", None)
    with pytest.warns(UserWarning):
        assert set(importlib.reload(e).queries()) == set(catalog.QUERIES)
    with pytest.warns(UserWarning):
        assert set(e.oracle_sql()) == set(catalog.ORACLE)

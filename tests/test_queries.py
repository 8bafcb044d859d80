"""Every registered query with a SQL twin gives DuckDB's rows; the others run and keep a stable schema."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from loomframe.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x)
    if isinstance(x, decimal.Decimal):
        return str(x)
    return x.isoformat() if hasattr(x, "isoformat") else repr(x)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_twin(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(registry.SQL[name])
    at = {c[0]: i for i, c in enumerate(res.description)}
    assert sorted(at) == cols
    assert got == sorted(repr(tuple(plain(r[at[c]]) for c in cols)) for r in res.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.limit(5).collect()


def test_entry_without_llm(spark, monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline" or "llm" in name.split("."):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    import __spark_entry__

    importlib.reload(__spark_entry__)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.SQL)
    assert __spark_entry__.entry(spark).count() > 0

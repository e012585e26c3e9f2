"""Every registered query of the comparison library runs, and those with SQL agree with it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from palimpsest.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect())
    if name in ORACLE_SQL:
        base = duckdb.connect()
        for f in os.listdir(SF):
            base.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        result = base.sql(ORACLE_SQL[name])
        at = [result.columns.index(c) for c in columns]
        assert sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall()) == got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_queries_stay_where_training_data_cannot_be_imported(monkeypatch):
    """A subpackage that is there, but lacks a module that it needs, takes nothing else along."""
    import importlib
    import sys
    import warnings

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("palimpsest.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    entry = importlib.reload(__spark_entry__)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        names = entry.queries()
        assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names and entry.oracle_sql()

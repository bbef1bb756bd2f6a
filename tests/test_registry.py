"""Each layout query against its DuckDB SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

from foliospark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = tables.execute(registry.oracle_sql()[name]).df()
    assert len(got)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["image_id", "group_id", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_corpus_queries(monkeypatch):
    """What the corpus queries need may be missing: the others are still there."""
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "foliospark.llm", None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())

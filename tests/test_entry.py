"""The driver's contract: names, and every query with SQL against DuckDB on the small tables."""

import math
import os

import pytest

import __spark_entry__ as entry


def test_the_core_never_imports_the_llm_folder():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "corpusmill")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                assert "corpusmill.llm" not in text and ".llm" not in text, name


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _rows(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer() else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{file}')")
    got = entry.queries()[name](spark, data).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want) and len(got)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0

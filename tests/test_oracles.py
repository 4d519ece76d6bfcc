"""Every query that has SQL gives the rows that DuckDB gives on the same files."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillmend.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).iterdir()):
        con.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v if isinstance(v, (int, bool, str)) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = rows(registry.queries()[name](spark, sf_dir).toPandas()), rows(duck.sql(registry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["p_partkey", "pos", "word", "adopted", "adopted_confidence", "level"]
    assert out.count() > 0


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The driver's contract: names, and each query against its SQL at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from covarium.plans import catalogue, commands  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 4) + 0.0)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def same(got, want):
    return sorted(tuple(plain(v) for v in r) for r in got) == sorted(tuple(plain(v) for v in r) for r in want)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["idx", "token", "freq"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = [tuple(dict(zip(rel.columns, r, strict=True))[c] for c in cols) for r in rel.fetchall()]
    assert same([tuple(r[c] for c in cols) for r in df.collect()], want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(catalogue._word_counts(spark, SF))
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["knn_words"](spark, SF))
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["knn_batch"](spark, SF))

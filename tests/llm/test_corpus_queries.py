"""Every registered corpus query; against its SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
from folioscope.llm import queries

ROOT = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations", "embeddings")

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_equals_sql(spark, sql, name):
    df = registered.queries()[name](spark, ROOT)
    got = rows_by_name(df.columns, df.collect())
    answer = sql.execute(registered.oracle_sql()[name])
    assert got == rows_by_name([d[0] for d in answer.description], answer.fetchall())
    assert got[1]


def test_all_are_registered():
    names = [n for n in registered.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in registered.queries()


@pytest.mark.parametrize("name", ["op6_chat_windows", "op7_mix_sources"])
def test_native(spark, monkeypatch, name):
    """No Python in any job of the query, those of its intermediate tables included."""
    from pyspark.sql import DataFrame, SparkSession, functions
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def none(*_, **__):
        raise AssertionError("Python work in a native query")

    for kind in (DataFrame, Classic):
        for method in ("mapInArrow", "mapInPandas", "toArrow", "toPandas", "rdd", "foreach", "foreachPartition"):
            monkeypatch.setattr(kind, method, property(none) if method == "rdd" else none)
    for function in ("udf", "pandas_udf", "udtf"):
        monkeypatch.setattr(functions, function, none)
    monkeypatch.setattr(SparkSession, "createDataFrame", none)
    df = registered.queries()[name](spark, ROOT)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))

import os

import pytest
from pyspark.sql import functions as F

from folioscope.sinks.store import PageStore


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def pages(spark):
    return lambda ids, run: spark.createDataFrame([(f"https://h/{i}", f"{run}:{i}") for i in ids], "url string, html string")


def test_newest_of_any_runs(spark, pages, tmp_path, exchanges):
    store, want = PageStore(spark, "t_runs", 4, str(tmp_path)), {}
    for run, ids in enumerate([range(40), range(0, 40, 2), range(30, 60), range(0, 60, 7)]):
        store.append(pages(ids, run))
        want |= {f"https://h/{i}": f"{run}:{i}" for i in ids}
        got = store.newest().collect()
        assert {r.url: r.html for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all("html" not in columns for columns, _ in exchanges(store.newest()))
        assert exchanges(store.newest()) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(store.compact()) == 64 or want
    assert {r.url: r.html for r in store.newest().collect()} == want
    assert store.compact() == []


def test_compaction_rewrites_touched_parts_only(spark, pages, tmp_path):
    store = PageStore(spark, "t_parts", 2, str(tmp_path))
    store.append(pages(range(300), 0))
    assert len(store.compact()) > 50
    base = tmp_path / "t_parts_base"
    before = files(base)
    store.append(pages([5, 7], 1))
    touched = store.compact()
    assert 1 <= len(touched) <= 2
    after = files(base)
    gone = {f.split("part=")[1].split("/")[0] for f in before - after}
    assert gone == {str(p) for p in touched} and len(before & after) > 0.9 * len(before) - 4
    got = {r.url: r.html for r in store.newest().collect()}
    assert got == {f"https://h/{i}": f"{1 if i in (5, 7) else 0}:{i}" for i in range(300)}
    assert [t.name for t in spark.catalog.listTables(pattern="t_parts_run*")] == []
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_other_columns_and_odd_keys(spark, tmp_path):
    store = PageStore(spark, "t_odd", 3, str(tmp_path), key="id")
    rows = lambda texts: spark.createDataFrame(texts, "id long, html string, extra int")
    store.append(rows([(1, None, 1), (2, "", 2), (-5, "x" * 100_000, None)]))
    store.append(rows([(2, "b", 3)]).select("extra", "html", "id"))
    store.append(rows([]))
    got = sorted(tuple(r) for r in store.newest().select("id", "html", "extra").collect())
    assert [g[0] for g in got] == [-5, 1, 2] and got[2] == (2, "b", 3) and got[1][1] is None
    store.compact()
    store.append(rows([(1, "again", 9)]))
    assert {r.id: r.extra for r in store.newest().collect()} == {1: 9, 2: 3, -5: None}
    assert store.newest().where(F.col("id") == 2).count() == 1

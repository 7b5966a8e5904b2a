import random

from pyspark.sql import functions as F

from folioscope.operators import documents, targets
from folioscope.operators.order import with_ordinal, with_sum_before


def test_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice(["x", "y", None]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, i int").repartition(7)
    got = [(r.a, r.b, r.i) for r in with_ordinal(df, "a", F.desc("b"), "i").orderBy("ordinal").collect()]
    assert got == [(r.a, r.b, r.i) for r in df.orderBy("a", F.desc("b"), "i").collect()]
    numbers = sorted(r.ordinal for r in with_ordinal(df, "i").collect())
    assert numbers == list(range(1, 2001))


def test_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,), (2,)], "k int")
    got = {r.ordinal: r.k for r in with_ordinal(df, "k", name="ordinal").collect()}
    assert [got[i] for i in range(1, 503)] == [0] + [1] * 500 + [2]
    assert with_ordinal(df.where("false"), "k").collect() == []


def test_no_row_meets_all_others(spark, exchanges):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    plan = with_ordinal(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan  # of counts per part
    assert all("k" not in columns for columns, _ in exchanges(with_ordinal(df, "k")))


def test_paths_by_parts_and_targets(spark):
    paths = ["apis/a-b.md", "apis/a/b.md", "apis/a.md", "b/a.md", "apis/a/b/c.md", "ref/é.md"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r.path for r in documents.numbered(files).orderBy("ordinal").collect()]
    assert got == sorted(paths, key=lambda p: p.split("/"))
    rows = [("b", "x", "u1"), ("a", "z", "u2"), ("a", "y", "u3"), ("a", "y", "u0")]
    got = targets.numbered(spark.createDataFrame(rows, "category string, slug string, url string")).collect()
    assert [(r.category, r.slug, r.url) for r in sorted(got, key=lambda r: r.ordinal)] == sorted(rows)


def test_sums_before_of_any_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 1, 7, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(6)
    for by, sign in (("k", 1), (F.desc("k"), -1)):
        got = {r.k: (r.g, r.before) for r in with_sum_before(df, "g", by, size="n").collect()}
        total = {}
        for g, k, n in sorted(rows, key=lambda r: sign * r[1]):
            assert got[k] == (g, total.get(g, 0))
            total[g] = total.get(g, 0) + (n or 0)
    assert with_sum_before(df.where("false"), "g", "k", size="n").collect() == []

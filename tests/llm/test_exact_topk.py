import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import exact_topk as X

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50, scale=256):
    kept = []
    for vec, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]))
    out = []
    for i, (vec, q) in enumerate(kept):
        if vec is not None and vec % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, x)), c is None, c or 0, c) for j, (c, x) in enumerate(kept) if j != i]
            out += [(vec, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def asked(every=50):
    return F.col("vec_id") % every == 0


def test_query_equals_brute_force(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    out = X.op13_exact_topk(spark, root)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert result(out) == brute(rows)


@pytest.mark.parametrize("block,queries,cell", [(1, 1, (2, 3)), (16, 4, (3, 2)), (64, 256, (32, 256))])
def test_any_blocks_and_cells(spark, monkeypatch, block, queries, cell):
    monkeypatch.setattr(X, "_CELL", cell)
    monkeypatch.setattr(X, "_STEP", 3)
    rng = random.Random(block)
    rows = [(i, [round(rng.gauss(0, 1), 1) * 0.7**d for d in range(8)], 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = X.top_k(df, asked(10), k=3, block=block, queries=queries)
    assert result(got) == brute([r[:2] for r in rows], 3, 10)


def test_bounds_spare_products_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(X, "_STEP", 4)
    rng = np.random.default_rng(5)
    falling = 0.6 ** np.arange(32)
    q = np.rint(rng.normal(size=(32, 50)) * falling[:, None] * 1000).astype(np.int64)
    best, work, seen = X.Best(q, 4), 0, []
    for b in range(10):
        x = np.rint(rng.normal(size=(32, 300)) * falling[:, None] * 1000).astype(np.int64)
        work += best.meet(np.arange(b * 300, b * 300 + 300), np.ones(300, dtype=bool), x)
        seen.append(x)
    full = (q.T @ np.concatenate(seen, axis=1))
    order = np.lexsort((np.broadcast_to(np.arange(3000), full.shape), -full), axis=1)[:, :4]
    assert (best.ids == order).all() and (best.scores == np.take_along_axis(full, order, axis=1)).all()
    assert work < 0.4 * full.size * 32


def test_large_numbers_are_exact():
    q = np.array([[1 << 27], [1]])
    best = X.Best(q, 2)
    best.meet(np.array([5, 4, 3]), np.array([True] * 3), np.array([[1 << 27, 1 << 27, -(1 << 27)], [0, 1, 1]]))
    assert best.scores.tolist() == [[(1 << 54) + 1, 1 << 54]] and best.ids.tolist() == [[4, 5]]


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.1, 0.2], 0), (0, [0.1, 0.2], 0), (0, [0.3, 0.2], 0), (None, [0.3, 0.2], 0), (None, None, None), (50, None, 1),
        (100, [], 1), (150, [0.5], 1), (200, [0.1, 0.2, 0.3], 1), (250, [nan, 0.1], 1), (300, [-inf, 0.1], 1), (350, [None], 1),
        (-50, [-0.1, -0.2], 1), *((i, [0.3, 0.2], 1) for i in range(400, 440)), *((i, [0.3, 0.2], 1) for i in range(400, 405)),
    ]
    names = ("x", "id", "score", "rank", "block", "place", "query_id", "times", "Cell")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    for k in (1, 4, 100):
        got = X.top_k(df, asked(), k=k, block=7, queries=2)
        assert result(got) == brute([r[:2] for r in rows], k)
    assert X.top_k(df.where("false"), asked()).collect() == []
    assert X.top_k(df.where("vec_id = 150"), asked()).collect() == []
    assert X.top_k(df.where("vec_id = 401"), asked()).collect() == []


def test_one_vector_on_most_rows(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [i / 900, 0.1], 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(X.top_k(df, asked(), block=64, queries=8)) == brute([r[:2] for r in rows])

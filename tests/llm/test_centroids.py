import hashlib
import random

import numpy as np
import pytest

from folioscope.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, scale=64, dims=64):
    """The clustering by its definition, on (id, vector) rows, with Python's whole numbers."""
    kept = []
    for vec, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    points = [list(x) for _, x in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, x in kept:
            of = [sum((a - b) ** 2 for a, b in zip(x, p)) for p in points]
            out.append((of.index(min(of)), min(of)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(points)):
            own = [x for (_, x), (of, _) in zip(kept, got) if of == c]
            if own:
                points[c] = [sum(column) // len(own) for column in zip(*own)]
    got = assign()
    inertia = [sum(d for of, d in got if of == c) for c in range(len(points))]
    name = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((vec, c, d, inertia[c], sum(inertia), name[c]) for (vec, _), (c, d) in zip(kept, got)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = C.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-9, 9, (rng.integers(1, 20), 3)) + rng.integers(-30, 30, 3)
        points = rng.integers(-40, 40, (8, 3))
        among = C.candidates(x.min(axis=0), x.max(axis=0), points)
        cluster, distance = C.nearest(x, points, among)
        full = ((x[:, None] - points) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_large_numbers_are_exact():
    x = np.array([[1 << 27, 3], [-(1 << 27), 3]])
    cluster, distance = C.nearest(x, np.array([[0, 0], [-(1 << 27), 2]]), np.array([0, 1]))
    assert cluster.tolist() == [0, 1] and distance.tolist() == [(1 << 54) + 9, 1]


def test_query_equals_brute_force(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    out = C.op11_centroid_clusters(spark, root)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(out) == brute(rows, 16, 3)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_separated_clusters_any_block(spark, block):
    rng = random.Random(block)
    middles = [[rng.uniform(-5, 5) for _ in range(4)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 6]], 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(C.cluster(df, k=6, rounds=4, dims=4, block=block)) == brute([r[:2] for r in rows], 6, 4, dims=4)


def test_boxes_spare_comparisons(spark):
    rng = random.Random(3)
    rows = [(i, [4.0 * (i % 5) + rng.gauss(0, 0.05) for _ in range(4)], 0) for i in range(1000)]
    zones = C.zone_maps(C.whole_numbers(spark.createDataFrame(rows, SCHEMA), 64, "vec_id", "embedding", 4), 4, 50)
    points = np.array([[256 * c] * 4 for c in range(5)])
    left = [len(C.candidates(np.frombuffer(z.low, np.int64), np.frombuffer(z.high, np.int64), points)) for z in zones.collect()]
    assert len(left) >= 20 and sum(n == 1 for n in left) > 0.7 * len(left)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2], 0), (1, [0.1, 0.2], 0), (1, [0.3, 0.2], 0), (None, [0.1, -0.2], 0), (None, None, None), (2, None, 1),
        (3, [], 1), (4, [0.1], 1), (5, [0.1, 0.2, 0.3], 1), (6, [nan, 0.1], 1), (7, [inf, 0.1], 1), (8, [None, 0.1], 1),
        (9, [-0.0, 0.0], 1), *((i, [0.5, 0.5], 1) for i in range(10, 60)),
    ]
    from pyspark.sql import functions as F

    names = ("x", "id", "cluster", "distance", "place", "mixed", "inertia", "Vec_Id2")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    for k in (1, 3, 100):
        assert result(C.cluster(df, k=k, dims=2, block=4)) == brute([r[:2] for r in rows], k, 3, dims=2)
    empty = C.cluster(df.where("false"), dims=2)
    assert empty.collect() == [] and empty.columns == C.cluster(df, dims=2).columns
    assert empty.schema == C.cluster(df, dims=2).schema or [f.dataType for f in empty.schema] == [f.dataType for f in C.cluster(df, dims=2).schema]
    with pytest.raises(Exception, match="components beyond"):
        C.cluster(spark.createDataFrame([(1, [3e30, 0.0], 0)], SCHEMA), dims=2).collect()


def test_equal_vectors_are_spread(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(3000)]
    zones = C.zone_maps(C.whole_numbers(spark.createDataFrame(rows, SCHEMA).repartition(4), 64, "vec_id", "embedding", 2), 2, 100)
    assert sorted(i for z in zones.collect() for i in z.ids) == list(range(3000))
    assert C.cluster(spark.createDataFrame(rows, SCHEMA), k=3, dims=2).select("cluster").distinct().collect()[0].cluster == 0

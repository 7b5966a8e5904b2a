"""Exact centroid clustering over zone maps: blocks of vectors in Hilbert order.

Vectors are sorted along a Hilbert curve through the directions in which they
vary most and cut into blocks. Each block knows the box it lies in and the sum
of its vectors. A centroid whose least distance to the box is more than another
one's greatest can't be nearest to any vector of the block; only the others are
compared, and where one is left the block goes to it as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import stored

# Workers get these helpers with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Vectors of a block.
BLOCK = 256
#: Directions of the curve and bits of each; together at most 63.
_AXES, _BITS = 8, 7
#: Components beyond this have squared distances beyond 64 bits.
_LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, scale: int, id: str, vector: str, dims: int | None = None) -> DataFrame:
    """``id`` and ``x``, the components as floor(scale * component); null or non-finite ones drop the vector."""
    given = F.col(f"`{vector}`")
    sound = given.isNotNull() & F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if dims is not None:
        sound = sound & (F.size(given) == dims)
    large = F.exists(given, lambda c: F.abs(c.cast("double") * scale) > _LARGEST)
    x = F.transform(given, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    checked = F.when(large, F.raise_error(F.lit(f"components beyond {_LARGEST} / {scale}"))).otherwise(x)
    return vectors.where(sound).select(F.col(f"`{id}`").alias("id"), checked.alias("x"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers below 2 ** bits."""
    x = [column.copy() for column in cells.astype(np.int64).T]
    level = 1 << bits - 1
    while level > 1:  # undo the turns and mirrors of the coarser levels
        low = level - 1
        for axis in x:
            up = (axis & level) > 0
            swap = np.where(up, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(up, low, swap)
            if axis is not x[0]:
                axis ^= swap
        level >>= 1
    for before, axis in zip(x, x[1:]):  # Gray code
        axis ^= before
    flip = np.zeros_like(x[0])
    level = 1 << bits - 1
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ flip) >> bit & 1)
    return key


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(dims: int):
    """Sums of components and of their products; a row per sum and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            values = np.concatenate([[n], sums, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    return run


def directions(rows: DataFrame, dims: int, axes: int = _AXES) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, main directions and the deviation along the first, of all vectors; they steer the order only."""
    sums = rows.select("x").mapInArrow(_moments(dims), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = np.array([r.value for r in sorted(sums.collect(), key=lambda r: r.place)])  # 1 + dims + dims * dims rows
    if not len(values):
        return np.zeros(dims), np.zeros((dims, 0)), 1.0
    n, mean = values[0], values[1 : dims + 1] / values[0]
    spread = values[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)
    variances, vectors = np.linalg.eigh(spread)
    order = np.argsort(variances)[::-1][:axes]
    return mean, vectors[:, order], float(np.sqrt(max(variances[order[0]], 1e-9)))


def _places(dims: int, frame: tuple[np.ndarray, np.ndarray, float]):
    """Adds each vector's place on the curve, and a number that spreads equal places over partitions."""
    mean, axes, width = frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            # the mean lies a third along each axis, off the borders of the coarse cells
            cells = np.clip(((x - mean) @ axes / width + 4) * (1 << _BITS) / 12, 0, (1 << _BITS) - 1)
            number = np.arange(seen, seen + len(x), dtype=np.uint64) + (np.uint64(task) << np.uint64(40))
            mixed = (number * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            seen += len(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, _BITS)), pa.array(mixed)], names=["id", "x", "place", "mixed"])

    return run


def _blocks(dims: int, size: int, kind: pa.DataType):
    """Cuts a partition's rows into blocks with their box and sum."""
    names = ["ids", "rows", "low", "high", "total"]

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        packed = [pa.array([a.tobytes()], pa.binary()) for a in (x.astype(np.int32), x.min(axis=0), x.max(axis=0), x.sum(axis=0))]
        listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.cast(kind))
        return pa.RecordBatch.from_arrays([listed, *packed], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            x, at = _matrix(batch.column(1), dims), 0
            while at < len(x):
                take = min(size - n, len(x) - at)
                ids.append(batch.column(0).slice(at, take))
                parts.append(x[at : at + take])
                n, at = n + take, at + take
                if n == size:
                    yield block(pa.concat_arrays(ids), np.concatenate(parts))
                    ids, parts, n = [], [], 0
        if n:
            yield block(pa.concat_arrays(ids), np.concatenate(parts))

    return run


def zone_maps(rows: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """(id, x) rows as a table of blocks in Hilbert order: ids, rows, low, high, total.

    Rows are sorted by ranges of the curve; equal places, such as those of one
    vector that many rows have, are spread by a second key.
    """
    id_type = rows.schema["id"].dataType
    placed = rows.mapInArrow(
        _places(dims, directions(rows, dims)),
        T.StructType([rows.schema["id"], rows.schema["x"], T.StructField("place", T.LongType()), T.StructField("mixed", T.LongType())]),
    )
    ordered = placed.repartitionByRange("place", "mixed").sortWithinPartitions("place", "mixed").select("id", "x")
    binary = [T.StructField(c, T.BinaryType()) for c in ("rows", "low", "high", "total")]
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *binary])
    return stored(ordered.mapInArrow(_blocks(dims, size, _arrow_type(id_type)), schema), "zones")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to something in the box, ascending."""
    near = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid of ``among`` (ties: the smallest) and its squared distance, exact."""
    chosen = centroids[among]
    largest = int(max(np.abs(x).max(), np.abs(chosen).max()))
    if 4 * largest * largest * x.shape[1] < 1 << 53:  # whole numbers that a double holds
        rows, points = x.astype(np.float64), chosen.astype(np.float64)
        squared = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ points.T + (points * points).sum(axis=1)
    else:
        squared = np.stack([((x - c) ** 2).sum(axis=1) for c in chosen], axis=1)
    best = squared.argmin(axis=1)
    return among[best], squared[np.arange(len(x)), best].astype(np.int64)


def _unpacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for rows, low, high, total in zip(*(batch.column(c) for c in ("rows", "low", "high", "total"))):
        x = np.frombuffer(rows.as_py(), dtype=np.int32).reshape(-1, dims).astype(np.int64)
        yield x, *(np.frombuffer(a.as_py(), dtype=np.int64) for a in (low, high, total))


def _sums(centroids: np.ndarray):
    """Count and sum of the vectors nearest to each centroid; a row per centroid and task."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for x, low, high, total in _unpacked(batch, dims):
                among = candidates(low, high, centroids)
                if len(among) == 1:
                    counts[among[0]] += len(x)
                    sums[among[0]] += total
                    continue
                cluster, _ = nearest(x, centroids, among)
                counts += np.bincount(cluster, minlength=k)
                for c in among:
                    sums[c] += x[cluster == c].sum(axis=0)
        found = np.flatnonzero(counts)
        if len(found):
            flat = pa.array(sums[found].ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * dims), flat)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found]), listed], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [nearest(x, centroids, candidates(low, high, centroids)) for x, low, high, _ in _unpacked(batch, dims)]
            if of:
                cluster, distance = (np.concatenate(a) for a in zip(*of))
                ids = batch.column("ids").flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def _moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""
    dims = centroids.shape[1]
    parts = zones.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    moved = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # a row per centroid
        moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return moved


def cluster(
    vectors: DataFrame,
    *,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    dims: int = DIMS,
    salt: str = "1",
    block: int = BLOCK,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` per vector.

    Vectors of exactly ``dims`` components, none null or non-finite, take part
    with their components as floor(scale * component); others give no row. The
    ``k`` vectors with the smallest sha256 of ``salt:id`` start as centroids
    (null ids last, equal hashes by components; fewer vectors, fewer centroids).
    Each round assigns all vectors to the nearest centroid by squared distance,
    ties to the smaller number, and moves centroids to the floor of the mean.
    Distances are exact. Repeated rows and ids count row by row; an empty table
    gives none. Other columns are not read, so their names can't clash.
    Components too large for distances of 64 bits are an error.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale, id, vector, dims)
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(hashed.asc_nulls_last(), "x").limit(k).select("x").collect()
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType())))])
    if not start:
        figures = [T.StructField(n, t) for n, t in (("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))]
        return spark.createDataFrame([], T.StructType([*out.fields, *figures])).withColumnRenamed("id", id)
    centroids = np.array([r.x for r in start], dtype=np.int64)
    zones = zone_maps(rows, dims, block)
    for _ in range(rounds):
        centroids = _moved(zones, centroids)
    assigned = stored(zones.mapInArrow(_assigned(centroids), out), "assigned")
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    figures = [
        (c, own, sum(inertia.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, own in inertia.items()
    ]
    known = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(known), "cluster")  # k rows at most
    return joined.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clusters(spark, root) -> DataFrame:
    return cluster(spark.read.parquet(f"{root}/embeddings.parquet"))


def sql(rounds: int = ROUNDS) -> str:
    step = """
      a{0} AS MATERIALIZED (
        SELECT rid, c, d FROM (
          SELECT rid, c, d, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS place FROM (
            SELECT l.rid, k.c, sum((l.y - k.y) * (l.y - k.y)) AS d FROM l JOIN k{0} k USING (i) GROUP BY ALL))
        WHERE place = 1)"""
    move = """
      k{1} AS MATERIALIZED (
        SELECT k.c, k.i, CASE WHEN m.n IS NULL THEN k.y ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS y
        FROM k{0} k LEFT JOIN (
          SELECT a.c, l.i, sum(l.y) AS s, count(*) AS n FROM a{0} a JOIN l USING (rid) GROUP BY ALL) m USING (c, i))"""
    rest = ",".join(step.format(i) + "," + move.format(i, i + 1) for i in range(rounds)) + "," + step.format(rounds)
    return f"""
      WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id,
          list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}),
      l AS MATERIALIZED (SELECT rid, unnest(range(1, {DIMS} + 1)) AS i, unnest(x) AS y FROM v),
      start AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x
        FROM v ORDER BY c LIMIT {CLUSTERS}),
      k0 AS MATERIALIZED (SELECT c, unnest(range(1, {DIMS} + 1)) AS i, unnest(x) AS y FROM start),
      {rest},
      own AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c),
      named AS (SELECT c, sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM k{rounds} GROUP BY c)
      SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
        CAST(own.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM own) AS BIGINT) AS inertia,
        named.h AS centroid_sha256
      FROM a{rounds} a JOIN v USING (rid) JOIN own ON own.c = a.c JOIN named ON named.c = a.c
    """

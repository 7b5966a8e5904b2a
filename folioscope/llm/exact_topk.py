"""Exact top-k by inner product: columnar branch and bound over blocks of vectors.

Blocks hold their vectors dimension by dimension. A block of queries meets a
block of candidates some dimensions at a time, those first in which the queries
are large. After each step a pair's score is at most what it has so far plus
the product of both lengths in the dimensions left; pairs that can't reach the
query's k-th score go, and the survivors are compacted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.centroids import whole_numbers
from folioscope.llm.common import stored

# Workers get these helpers with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
SCALE = 256
EVERY = 50
#: Vectors of a block of candidates and of queries.
BLOCK, QUERIES = 4096, 256
#: Blocks of candidates and of queries that one task compares, at most about.
_CELL = (32, 256)
#: Components of a block, for vectors longer than usual.
_LARGEST_BLOCK = 1 << 18
#: Dimensions of a step.
_STEP = 16
#: Share of pairs left at which they are followed one by one.
_FEW = 1 / 16
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BLOCK_SCHEMA = "block long, n int, ids array<long>, times array<long>, rows binary"


def _vertical(size: int):
    """Cuts (id, x, times) rows of a task into blocks, dimension by dimension; short vectors end in zeros."""

    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        dims = max(len(x) for _, x, _ in rows)
        packed = np.zeros((dims, len(rows)), dtype=np.int32)
        for i, (_, x, _) in enumerate(rows):
            packed[: len(x), i] = x
        values = [number], [len(rows)], [[r[0] for r in rows]], [[r[2] for r in rows]], [packed.tobytes()]
        kinds = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "n", "ids", "times", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, longest = TaskContext.get().partitionId() << 32, [], 1
        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in batch.column(1)])
            vectors = np.split(flat, ends[:-1]) if len(ends) else []
            for row in zip(batch.column(0).to_pylist(), vectors, batch.column(2).to_pylist()):
                waiting.append(row)
                longest = max(longest, len(row[1]))
                if len(waiting) == size or len(waiting) * longest >= _LARGEST_BLOCK:
                    yield block(number, waiting)
                    number, waiting, longest = number + 1, [], 1
        if waiting:
            yield block(number, waiting)

    return run


class Best:
    """The best candidates of a block of queries so far, best first; ties by id, nulls last."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries = queries  # dimensions by queries
        self.k = k
        n = queries.shape[1]
        self.scores, self.ids = np.full((n, k), _NONE), np.full((n, k), _LAST)
        self.known = np.zeros((n, k), dtype=bool)

    def meet(self, ids: np.ndarray, known: np.ndarray, candidates: np.ndarray) -> int:
        """Take in a block of candidates (dimensions by candidates); how many products that took."""
        dims = min(len(self.queries), len(candidates))
        q, x = self.queries[:dims], candidates[:dims]
        largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(dims, 1)
        if largest > _LAST:
            raise OverflowError("scores beyond 64 bits")
        kind = np.float64 if largest < 1 << 53 else np.int64  # both exact
        q, x = q.astype(kind), x.astype(kind)
        squares = np.square(q, dtype=np.float64).sum(axis=1)
        order = np.argsort(-squares, kind="stable")
        left_q, left_x = (np.square(a[order], dtype=np.float64) for a in (q, x))
        worst = self.scores[:, -1]
        rows, columns = np.arange(q.shape[1]), np.arange(x.shape[1])
        scores, pairs, work = np.zeros((len(rows), len(columns)), dtype=kind), None, 0
        for at in range(0, dims, _STEP):
            now = order[at : at + _STEP]
            rest_q, rest_x = (np.sqrt(a[at + _STEP :].sum(axis=0)) for a in (left_q, left_x))
            if pairs is None:
                scores = scores + q[np.ix_(now, rows)].T @ x[np.ix_(now, columns)]
                work += scores.size * len(now)
                alive = self._alive(scores, rest_q[rows][:, None] * rest_x[columns], worst[rows][:, None])
                if alive.sum() < _FEW * alive.size:
                    r, c = np.nonzero(alive)
                    pairs, scores = (rows[r], columns[c]), scores[r, c]
                else:
                    keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
                    rows, columns, scores = rows[keep_r], columns[keep_c], scores[np.ix_(keep_r, keep_c)]
            else:
                r, c = pairs
                scores = scores + (q[np.ix_(now, r)] * x[np.ix_(now, c)]).sum(axis=0)
                work += scores.size * len(now)
                alive = self._alive(scores, rest_q[r] * rest_x[c], worst[r])
                pairs, scores = (r[alive], c[alive]), scores[alive]
        if pairs is None:
            pairs, scores = (np.repeat(rows, len(columns)), np.tile(columns, len(rows))), scores.ravel()
        self._merge(*pairs, scores.astype(np.int64), ids, known)
        return work

    @staticmethod
    def _alive(scores: np.ndarray, rest: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Whether a pair may still be among the best; the bound is rounded up."""
        bound = scores + rest
        return (bound + 1e-9 * (np.abs(bound) + rest) + 0.5 >= worst) | (worst == _NONE)

    def _merge(self, r: np.ndarray, c: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        better = (scores > self.scores[r, -1]) | (scores == self.scores[r, -1]) & (ids[c] <= self.ids[r, -1])
        r, c, scores = r[better], c[better], scores[better]
        if not len(r):
            return
        met = np.unique(r)
        rows = np.concatenate([np.repeat(met, self.k), r])
        of = [np.concatenate(x) for x in ((self.scores[met].ravel(), scores), (self.ids[met].ravel(), ids[c]), (self.known[met].ravel(), known[c]))]
        order = np.lexsort((of[1], ~of[2], ~of[0], rows))  # ~ turns whole numbers round without overflow
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        order, rows, place = order[keep], rows[keep], place[keep]
        for own, values in zip((self.scores, self.ids, self.known), of):
            own[rows, place] = values[order]


def _unpacked(table: pa.Table) -> Iterator[tuple]:
    """block, ids, known, times, rows of each block."""
    for block, n, ids, times, rows in zip(*(table.column(c).to_pylist() for c in ("block", "n", "ids", "times", "rows"))):
        known = np.array([i is not None for i in ids])
        yield block, np.array([_LAST if i is None else i for i in ids], dtype=np.int64), known, times, np.frombuffer(rows, dtype=np.int32).reshape(-1, n).astype(np.int64)


def _compared(k: int):
    """A cell's blocks of queries against its blocks of candidates."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        asked = [(block, ids, times, Best(rows, k)) for block, ids, _, times, rows in _unpacked(queries)]
        for _, ids, known, _, rows in _unpacked(candidates):
            for *_, best in asked:
                best.meet(ids, known, rows)
        parts = []
        for block, ids, times, best in asked:
            r, place = np.nonzero(best.scores != _NONE)
            own = (best.queries * best.queries).sum(axis=0)
            found = pa.array(best.ids[r, place], mask=~best.known[r, place])
            columns = [np.full(len(r), block), r.astype(np.int32), ids[r], np.array(times, dtype=np.int64)[r], own[r], found, best.scores[r, place]]
            parts.append(pa.Table.from_arrays([pa.array(c) for c in columns], names=_FOUND))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], pa.int32() if n == "place" else pa.int64()) for n in _FOUND})

    return run


_FOUND = ["block", "place", "query_id", "times", "own", "vec_id", "score"]
_FOUND_SCHEMA = ", ".join(f"{n} {'int' if n == 'place' else 'long'}" for n in _FOUND)


def top_k(
    vectors: DataFrame,
    asked: Column,
    *,
    k: int = K,
    scale: int = SCALE,
    block: int = BLOCK,
    queries: int = QUERIES,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows for each row that is ``asked``.

    Components become floor(scale * component); the score is the inner product,
    exact, highest first, ties to the smaller id and null ids last. Every row but
    the query's own is a candidate: a repeated row is one too, and a repeated
    query gets its rows again. Vectors that are null or hold null or non-finite
    components take no part; of two lengths the shorter one goes on with zeros,
    and an empty vector scores 0. ``asked`` is a condition on ids (integers).
    An empty table gives no rows. Other columns are not read.

    Blocks of queries and candidates are dealt to cells, each candidate block
    once for every group of queries; a cell's size is fixed, not its number.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale, id, vector).withColumn("id", F.col("id").cast("long"))
    candidates = stored(rows.withColumn("times", F.lit(1).cast("long")).mapInArrow(_vertical(block), _BLOCK_SCHEMA), "vectors")
    each = whole_numbers(vectors.where(asked), scale, id, vector).withColumn("id", F.col("id").cast("long"))
    each = each.where("id is not null").groupBy("id", "x").agg(F.count("*").alias("times"))
    wanted = stored(each.mapInArrow(_vertical(queries), _BLOCK_SCHEMA), "queries")
    n_candidates, n_queries = candidates.count(), wanted.count()
    cores = spark.sparkContext.defaultParallelism
    across = max(1, -(-n_candidates // _CELL[0]), min(n_candidates, 4 * cores))
    down = max(1, -(-n_queries // _CELL[1]))
    tasks = min(across * down, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))

    def dealt(blocks: DataFrame, own: int, others: int, cell) -> DataFrame:
        group = F.pmod(F.xxhash64("block"), F.lit(own))
        copies = blocks.withColumn("group", group).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return copies.withColumn("cell", cell(F.col("group"), F.col("other"))).drop("group", "other").repartition(tasks, "cell")

    left = dealt(candidates, across, down, lambda own, other: own * down + other)
    right = dealt(wanted, down, across, lambda own, other: other * down + own)
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_compared(k + 1), _FOUND_SCHEMA)

    by_query = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("at", F.row_number().over(by_query)).where(F.col("at") <= k + 1)
    itself = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    seen = F.sum(itself.cast("int")).over(by_query.rowsBetween(Window.unboundedPreceding, 0))
    others = best.withColumn("seen", seen).where(~(itself & (F.col("seen") == 1)))
    ranked = others.withColumn("rank", (F.col("at") - F.least(F.col("seen"), F.lit(1))).cast("int")).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.withColumn("again", again).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark, root) -> DataFrame:
    return top_k(spark.read.parquet(f"{root}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


SQL = f"""
  WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id,
      list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
  scored AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id,
      coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS score
    FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % {EVERY} = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored)
  SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= {K}
"""

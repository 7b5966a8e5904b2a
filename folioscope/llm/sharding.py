"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import digits, stored

#: Bits of a row's hash: 15 hexadecimal digits.
BITS = 60
#: Bits that one pass over the sizes looks at.
STEP = 12


def _prefix(bits: Column | str, depth: Column | int) -> Column:
    return F.shiftright(bits, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright({bits}, {BITS} - depth)")


def _buckets(cells: DataFrame, low: int, high: int) -> DataFrame:
    """The buckets above each cell, at depths ``low`` to ``high``, with their totals."""
    every = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return (
        every.groupBy("depth", _prefix("first", F.col("depth")).alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("largest").alias("largest"),
             F.min("first").alias("first"), F.max("last").alias("last"))
        # A bucket of one hash value: no further bit splits it.
        .withColumn("alike", F.col("first") == F.col("last"))
    )


def directory(sizes: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The directory for rows of (``hash``, ``bytes``), a table for each STEP bits.

    Depth 0 is one bucket for all. A bucket above ``max_bytes`` splits on its
    next bit; buckets that fit stay as they are, so depths differ. Each pass
    sums sizes by the next STEP bits, for the rows of buckets still too large
    only, and finds in these sums the depth at which each cell's bucket fits:
    as many passes as the deepest bucket has steps, not one per bit. A row
    names a cell: ``cell``, its ``depth`` (null: look in the next table), and
    ``bytes``, ``rows``, ``largest`` of its bucket.
    """
    tables: list[DataFrame] = []
    open_rows, low = sizes, 0
    while True:
        high = low + STEP
        cells = stored(
            open_rows.groupBy(_prefix("hash", high).alias("cell")).agg(
                F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.max("bytes").alias("largest"),
                F.min("hash").alias("first"), F.max("hash").alias("last")),
            "cells",
        )
        fits = _buckets(cells, low, high).where((F.col("bytes") <= max_bytes) | F.col("alike"))
        at = cells.select("cell", "first", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        at = at.select("cell", "depth", _prefix("first", F.col("depth")).alias("prefix"))
        found = at.join(fits, ["depth", "prefix"]).groupBy("cell").agg(
            F.min_by(F.struct("depth", "bytes", "rows", "largest"), "depth").alias("leaf"))
        table = stored(cells.select("cell").join(found, "cell", "left").select("cell", "leaf.*"), "directory")
        tables.append(table)
        pending = table.where("depth is null").select("cell")
        if high == BITS or pending.isEmpty():
            return tables
        open_rows = open_rows.join(pending, _prefix("hash", high) == F.col("cell"), "left_semi")
        low = high


#: Rows of a chain that are summed in one task, about.
_GROUP = 1_000_000


def _chains(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of buckets of one hash that don't fit, in shards of their own.

    A row above half the limit is a shard. The others are lined up, the largest
    first, and cut at every half of the limit: a shard has the rows that begin
    in one half, so none exceeds the limit. A chain is dealt to groups of about
    eight limits of bytes, so no task has all of it.
    """
    half = max(1, max_bytes // 2)
    # Stored, so that a task that runs again sees its rows in the same order.
    chained = stored(rows, "chains").withColumn("at", F.monotonically_increasing_id())
    groups = F.ceil(F.greatest(F.col("bytes") / (8.0 * max_bytes), F.col("rows") / _GROUP))
    salted = chained.withColumn("salt", F.pmod(F.xxhash64("at"), groups)).withColumn("alone", F.col("n_bytes") > half)
    by_size = Window.partitionBy("hash", "salt", "alone").orderBy(F.desc("n_bytes"), "at")
    before = F.coalesce(F.sum("n_bytes").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.when(F.col("alone"), F.concat(F.lit("x"), F.row_number().over(by_size))).otherwise(F.floor(before / half).cast("string"))
    named = salted.withColumn("number", number).withColumn("shard", F.concat_ws("-", "shard", F.col("salt").cast("string"), "number"))
    own = Window.partitionBy("hash", "shard")
    return named.withColumn("bytes", F.sum("n_bytes").over(own)).withColumn("rows", F.count("*").over(own))


def shard(
    docs: DataFrame,
    max_bytes: int,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    size: Column | None = None,
) -> DataFrame:
    """Every row of ``docs`` with its shard; no row is lost or doubled.

    Adds ``n_bytes`` (of ``text`` in UTF-8 unless ``size`` says else; null: 0),
    ``shard`` (``s`` and the hash bits that name it; ``-i`` behind it for the
    parts of a chain), ``depth``, ``shard_bytes`` and ``shard_rows`` of its
    bucket. A shard holds at most ``max_bytes``, but for a single row that is
    larger: it is alone. Rows of one key have one hash, so bits can't part
    them; if they don't fit together they form a chain of shards, filled by
    prefix sums of their sizes within bounded groups of the chain; each shard of
    a chain has its own ``shard_bytes`` and ``shard_rows``. Null keys hash
    like empty ones. Added columns replace columns of the same name.

    Only hashes and sizes are gathered to build the directory. Rows meet it by
    their leading bits, even if one key holds most of them: its table is small
    and sent to all tasks if its files are, else both sides meet by hash bits
    and adaptive execution splits a hot one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    text_of_keys = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        digits(text_of_keys, 15).alias("hash"),
        size.cast("long").alias("n_bytes"),
    )
    tables = directory(stored(rows.select("hash", F.col("n_bytes").alias("bytes")), "sizes"), max_bytes)
    leaf = F.lit(None)
    for step, table in enumerate(tables):
        own = table.select(F.col("cell").alias(f"cell{step}"), F.when(F.col("depth").isNotNull(), F.struct(
            "depth", "bytes", "rows", "largest")).alias(f"leaf{step}"))
        rows = rows.join(own, _prefix("hash", (step + 1) * STEP) == F.col(f"cell{step}"), "left")
        leaf = F.coalesce(F.col(f"leaf{step}"), leaf) if step else F.col("leaf0")
    placed = rows.select("row", "hash", "n_bytes", leaf.alias("leaf")).select("row", "hash", "n_bytes", "leaf.*")
    bits = F.expr(f"substring(lpad(bin(hash), {BITS}, '0'), 1, depth)")
    placed = placed.withColumn("shard", F.concat(F.lit("s"), bits))

    fits = (F.col("bytes") <= max_bytes) | (F.col("rows") == 1)
    parts = placed.where(fits)
    if not reduce(DataFrame.union, tables).where(~fits).isEmpty():
        parts = parts.unionByName(_chains(placed.where(~fits), max_bytes).select(placed.columns))
    outputs = {"n_bytes": "n_bytes", "shard": "shard", "depth": "depth", "shard_bytes": "bytes", "shard_rows": "rows"}
    kept = [f"row.`{c}`" for c in docs.columns if c.lower() not in outputs]
    return parts.select(*kept, *[F.col(c).alias(name) for name, c in outputs.items()])


#: Shards for reading at random: one MiB of text.
MAX_BYTES = 1 << 20


def op1_shard_documents(spark, root, max_bytes: int = MAX_BYTES) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")
    return shard(docs, max_bytes).drop("text")


def sql(max_bytes: int = MAX_BYTES) -> str:
    """Sums of the buckets at every depth; a document's is the first that fits."""
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, h, k.depth::INT AS depth, h >> ({BITS} - k.depth)::INT AS prefix
  FROM d, range(0, {BITS} + 1) k(depth)),
b AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM levels GROUP BY ALL
  HAVING sum(n_bytes) <= {max_bytes} OR min(h) = max(h)),
leaf AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, any_value(h) AS h, min(depth) AS depth
  FROM levels JOIN b USING (depth, prefix) GROUP BY doc_id)
SELECT doc_id, n_bytes, 's' || substr(lpad(bin(h), {BITS}, '0'), 1, leaf.depth) AS shard, leaf.depth AS depth,
  shard_bytes, shard_rows
FROM leaf JOIN b ON leaf.depth = b.depth AND b.prefix = h >> ({BITS} - leaf.depth)::INT
"""

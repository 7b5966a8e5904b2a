"""Mix sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import digits, matched, n_words, stored

_UNIT = 1 << 52


def source_sizes(docs: DataFrame, *, source: str = "source", size: Column | None = None) -> DataFrame:
    """One row per source: ``source``, ``source_size``. Partial sums meet, so a
    hot source costs no more than any other. A null source is a source."""
    size = n_words(F.col("text")) if size is None else size
    return (
        docs.select(F.col(source).alias("source"), size.alias("size"))
        .groupBy("source")
        .agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    )


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``weight``: 1 to ``cycle``, repeating, by source name in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", (F.lit(1) + (rank - 1) % cycle).cast("long"))


def target_sizes(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Share the total of ``source_size`` by ``weight``; adds ``target``.

    A target stops at ``max_repeats`` times its source; the excess goes to the
    others by weight, until none is above. With sources in the order of the
    share at which they stop, those that stop are a prefix, so prefix sums
    give the fixed point at once. The table has a row per source, not per
    document; it is the only one that a window orders as a whole. Sources
    without words have target 0; weights are positive whole numbers.
    """
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stop = F.col("source_size") * max_repeats
    so_far = (
        sources.withColumn("stop", stop)
        .withColumn("spent", F.coalesce(F.sum("stop").over(before), F.lit(0)))
        .withColumn("served", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
    )
    stops = F.col("stop").cast("double") * (F.col("weights") - F.col("served")) <= (
        F.col("total") - F.col("spent")
    ).cast("double") * F.col("weight")
    left = so_far.withColumn("stops", stops)
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("stop")).otherwise(0)).over(whole)
    share = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(whole)
    fair = rest.cast("double") * F.col("weight") / share
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(fair)
    return left.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(
    docs: DataFrame,
    targets: DataFrame,
    *,
    seed: int = 42,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """How often each document is taken: ``row`` (the document's columns as a
    struct), ``size``, ``source_size``, ``target``, ``copies``.

    A source's rate is its target over its size. Each of its documents is
    taken floor(rate) times, and once more if a number hashed from the seed,
    its id and its text is below the rate's fraction; so reruns, other
    partitions and lost executors change nothing. Rows alike in id and text
    decide alike. The input's own columns are kept apart, whatever their names.
    A null text has size 0. ``targets`` is small and read from a table, so
    Spark sends it to all tasks if its files are; otherwise both sides meet by
    source and adaptive execution splits a hot one.
    """
    size = n_words(F.col(text)) if size is None else size
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("source"),
        size.alias("size"),
        digits(key, 13).alias("chance"),
    )
    joined = matched(rows, targets, ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = F.col("chance") < (rate - whole) * F.lit(float(_UNIT))
    return joined.select("row", "size", "source_size", "target", (whole + extra.cast("long")).alias("copies"))


def mix(
    docs: DataFrame,
    *,
    weights=cycled_weights,
    max_repeats: int = 3,
    seed: int = 42,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """The mixed corpus: each document as often as ``plan`` says, same columns.

    ``weights`` adds ``weight`` to the table of sources. An empty corpus stays
    empty; documents of a source whose target is 0 are left out only if the
    source has no words, and then keep no copy. A null source is a source of its
    own; a null or empty text has size 0 and is repeated at its source's rate;
    rows alike in id and text are drawn alike. Columns may have any names.
    """
    sizes = weights(source_sizes(docs, source=source, size=size if size is not None else n_words(F.col(text))))
    targets = stored(target_sizes(sizes, max_repeats), "targets")
    planned = plan(docs, targets, seed=seed, id=id, text=text, source=source, size=size)
    return planned.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op7_mix_sources(spark, root) -> DataFrame:
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "source")
    targets = stored(target_sizes(cycled_weights(source_sizes(docs))), "targets")
    planned = plan(docs, targets)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select("row.doc_id", "size", "source_size", "target", taken)


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: The same by rounds of resharing: a source that a round finds above its stop is out of the next.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, {_WORDS}::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS t, sum(weight)::BIGINT AS w, count(*) AS n FROM s),
rounds AS (
  SELECT 0 AS k, t AS rest, w AS share, 0::BIGINT AS stopped FROM total
  UNION ALL
  SELECT k + 1, rest_, share_, stopped_ FROM (
    SELECT r.k, r.stopped,
      (SELECT t FROM total) - coalesce(sum(3 * source_size) FILTER (out), 0)::BIGINT AS rest_,
      coalesce(sum(weight) FILTER (NOT out), 0)::BIGINT AS share_, count(*) FILTER (out) AS stopped_
    FROM rounds r, LATERAL (SELECT *, (3 * source_size)::DOUBLE * r.share <= r.rest::DOUBLE * weight AS out FROM s) GROUP BY ALL)
  WHERE stopped_ > stopped),
last AS (SELECT * FROM rounds ORDER BY k DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN (3 * source_size)::DOUBLE * share <= rest::DOUBLE * weight
    THEN (3 * source_size)::DOUBLE ELSE rest::DOUBLE * weight / share END AS target FROM s, last),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + (chance < (rate - floor(rate)) * 4503599627370496.0)::INT) * size)::BIGINT AS taken FROM r
"""

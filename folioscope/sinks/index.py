"""The stored search index: documents and postings bucketed by document."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import TOKEN
from folioscope.operators import documents
from folioscope.operators.search import BAD_TOP_K, DEFAULT_TOP_K, EMPTY_QUERY, MAX_TOP_K

#: Documents of a bucket and bytes of their texts, at most about: one task sorts
#: their postings, and scores them for all queries of a batch.
BUCKET_DOCUMENTS, BUCKET_BYTES = 2048, 16 << 20

# Session setting: whether a scan may leave the buckets of a table for splits of its files.
_ANY_SPLIT = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def buckets_for(documents: DataFrame, least: int = 1) -> int:
    """How many buckets to give an index over ``documents``.

    A bucket is what one task sorts and scores, so their number follows the
    input and not their size, up to as many as the session allows a table.
    """
    most = int(documents.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    number, size = documents.agg(F.count("*"), F.sum(F.octet_length("text").cast("bigint"))).first()
    return min(most, max(least, -(-number // BUCKET_DOCUMENTS), -(-(size or 0) // BUCKET_BYTES)))


def write_index(enriched: DataFrame, name: str, buckets: int, key: str = "doc_id", path: str | None = None) -> None:
    """Write ``<name>_documents`` and ``<name>_postings``, below ``path`` if there is one.

    One shuffle of the texts places the documents; their postings are derived
    from the stored table, where they lie. Both tables share the bucketing, so
    scoring needs no exchange, and postings are sorted by term, so a query of
    constant terms reads only the row groups that hold them. A task holds a
    bucket: take their number from ``buckets_for``.
    """
    _save(enriched.repartition(buckets, key), f"{name}_documents", buckets, key, key, path)
    stored = enriched.sparkSession.table(f"{name}_documents")
    with _bucket_by_bucket(enriched.sparkSession):
        _save(documents.postings(documents.counted(stored), key), f"{name}_postings", buckets, key, "term", path)


@contextmanager
def _bucket_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Scans planned within have a task per bucket; a split of files may hold many."""
    before = spark.conf.get(_ANY_SPLIT)
    spark.conf.set(_ANY_SPLIT, "false")
    try:
        yield
    finally:
        spark.conf.set(_ANY_SPLIT, before)


def _save(df: DataFrame, table: str, buckets: int, key: str, sort: str, path: str | None) -> None:
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(sort)
    (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)


def read_index(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.table(f"{name}_documents"), spark.table(f"{name}_postings")


#: Words of a query that the scan looks for one by one; of more, it reads the range they span.
_SLOTS = 16


def search_function(spark: SparkSession, name: str, key: str = "doc_id") -> None:
    """Make ``<name>_search(query, top_k)`` a table function of this session.

    It reads the stored index. An empty query and a ``top_k`` that is not
    between 1 and 20 are errors; without one it is 5. The words of a query that
    is a constant fold into the scan's filter, so row groups without them are
    skipped. Each task keeps its best documents, as many as any request may have.
    """
    kind = spark.table(f"{name}_documents").schema[key].dataType.simpleString()
    order = f"split({key}, '/')" if kind == "string" else key
    words = f"array_distinct(regexp_extract_all(lower(asked), '{TOKEN}', 0))"
    slots = ", ".join(f"coalesce(get({words}, {i}), get({words}, 0), '')" for i in range(_SLOTS))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(asked STRING, top_k INT DEFAULT {DEFAULT_TOP_K})
        RETURNS TABLE ({key} {kind}, name STRING, title STRING, uri STRING, description STRING, score DOUBLE)
        RETURN
          WITH words AS (
            SELECT word, count(*) AS weight
            FROM (SELECT explode(regexp_extract_all(lower(
                CASE WHEN coalesce(length(asked), 0) < 1 THEN raise_error('{EMPTY_QUERY}') ELSE asked END), '{TOKEN}', 0)) AS word)
            GROUP BY word
          ),
          found AS (
            SELECT {key}, term, tf, norm FROM {name}_postings
            WHERE CASE WHEN size({words}) <= {_SLOTS} THEN term IN ({slots})
                       ELSE term BETWEEN array_min({words}) AND array_max({words}) END
          ),
          scored AS (
            SELECT p.{key},
                   CAST(sum(p.tf * w.weight) AS DOUBLE)
                     / (max(p.norm) * (SELECT sqrt(CAST(sum(weight * weight) AS DOUBLE)) FROM words)) AS score
            FROM found p JOIN words w ON p.term = w.word
            GROUP BY p.{key}
          ),
          best AS (
            SELECT *, row_number() OVER (ORDER BY score DESC, {order}) AS rk
            FROM (SELECT * FROM scored ORDER BY score DESC, {order} LIMIT {MAX_TOP_K})
          )
          -- a row, not a constant: a limit of 0 must fail, not prune the query
          SELECT b.{key}, d.name, d.title, d.uri, d.description, b.score
          FROM (SELECT CASE WHEN coalesce(top_k BETWEEN 1 AND {MAX_TOP_K}, FALSE) THEN top_k
                       ELSE raise_error('{BAD_TOP_K}') END AS k) c
          JOIN best b ON b.rk <= c.k JOIN {name}_documents d ON b.{key} = d.{key}
    """)

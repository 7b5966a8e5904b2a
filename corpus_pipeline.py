"""From raw documents to shards for training: each stage calls one operator.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with the
columns of ``documents``; the last one returns them with their shards.

In every stage columns may have any names and hold nulls, texts are read whole,
and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, mixing, perplexity, sharding, simhash
from folioscope.llm.common import stored

#: SQL can't express the language model, nor SimHash on whole tables in good time.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality rules reject.

    Null, empty and short texts are rejected; repeated rows by their own text each.
    """
    return perplexity.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Null ids come last; of rows that share an id the smallest text hash decides,
    and rows alike in id and text are one.
    """
    return simhash.one_of_each(docs, words_each=simhash.WORDS_EACH, max_bits=simhash.MAX_BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain an item of the benchmark.

    Null and empty texts contain none; repeated rows stay or go alike.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, width=decontaminate.WIDTH, least=decontaminate.LEAST)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for.

    A null source is a source; a null or empty text has no words and goes by its
    source's rate; rows alike in id and text are drawn alike.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard they belong to.

    A null text has no bytes and a null id hashes like an empty one; rows of one
    id that don't fit together form a chain of shards. No row is lost.
    """
    return sharding.shard(docs, sharding.MAX_BYTES)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("mixed", mixed),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A tree of Markdown files as a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import read_tree


class EmptyCorpusError(RuntimeError):
    """The corpus root holds no document."""


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) for every ``*.md`` file below ``root``; ``path`` is relative.

    Line ends are normalised as text mode does. Spark does not list empty files
    or names starting with ``_`` or ``.``.
    """
    return read_tree(spark, root, "*.md").select("path", F.regexp_replace("text", "\r\n?", "\n").alias("text"))


def require_documents(df: DataFrame) -> DataFrame:
    if not df.select(F.lit(1)).head(1):  # one task after another: isEmpty starts them all
        raise EmptyCorpusError("no document in the corpus")
    return df

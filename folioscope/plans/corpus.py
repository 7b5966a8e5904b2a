"""Markdown tree to search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import documents
from folioscope.sources.markdown import read_markdown, require_documents


def load(spark: SparkSession, root: str, uri_prefix: str) -> DataFrame:
    """The documents table of a Markdown tree; its key is ``path``. An empty
    tree is an error."""
    named = documents.with_identity(read_markdown(spark, root), uri_prefix)
    return documents.enrich(require_documents(named))
